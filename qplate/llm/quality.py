"""Quality rules of documents: word rules inside a document and cross-document line frequency per host.

DataFrame functions only.  A document fails the base rules when it has fewer than ``min_words`` words or
when more than ``max_repeat_pct`` percent of its words lie in 5-word windows found twice or more in it.
Of the others, lines that more than ``ratio`` of the host's distinct documents share (``min_docs`` of them at least)
are taken out, and a document that keeps less than ``min_kept`` of its words is depleted and rejected.

NULL and empty texts have no words and fail.  Repeated rows get the same verdict each; documents with equal
texts count as one in the line statistics.  NULL hosts form a host of their own.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qplate.llm.common import let, row_key, spare
from qplate.llm.lines import SPACES, common_lines, host, host_lines, normal, split_lines

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def _window_hashes(w: Column) -> Column:
    n = F.size(w)
    return F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])))


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; sorting brings equal windows together."""

    def covered(starts: Column) -> Column:
        # each start adds the words up to the next start, five at most
        return F.aggregate(
            F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x)

    def starts_of(pairs: Column) -> Column:
        h = lambda i: F.get(pairs, i)["h"]
        twice = F.filter(pairs, lambda p, i: (F.coalesce(h(i - 1) == p["h"], F.lit(False)) & (i > 0))
                         | F.coalesce(h(i + 1) == p["h"], F.lit(False)))
        return F.array_sort(F.transform(twice, lambda p: p["i"]))

    pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(hashes.isNull() | (F.size(F.array_distinct(hashes)) == F.size(hashes)), F.lit(0)) \
        .otherwise(let(pairs, lambda p: let(starts_of(p), covered)))


def base_rules(docs: DataFrame, min_words: int = 10, max_repeat_pct: int = 20, id_col: str = "doc_id",
               text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, k1, k2, host (the row key) and the base figures, row by row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(split_lines(F.col(text_col)), lambda x: normal(x) != "")
    figures = let(words(F.col(text_col)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        let(_window_hashes(w), _repeated_words).cast("long").alias("n_repeat_words")))
    d = docs.select(
        F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), host(F.col(host_col)).alias("host"),
        figures.alias("f"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    d = d.select("doc_id", "k1", "k2", "host", "f.n_words", "word_chars", "n_symbols", "n_dup_lines", "f.n_repeat_words")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def quality_rules(docs: DataFrame, min_docs: int = 2, ratio: float = 0.1, min_kept: float = 0.3,
                  min_words: int = 10, max_repeat_pct: int = 20, id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source") -> DataFrame:
    """One row per input row: the base figures, base_failed, n_common_words (words in removed lines), kept
    and the row key (k1, k2, host)."""
    base = base_rules(docs, min_words, max_repeat_pct, id_col, text_col, host_col)
    common = common_lines(docs, text_col, host_col, id_col, min_docs, ratio).select("host", "line")
    key = ["k1", "k2", "host"]
    gone = (host_lines(docs, text_col, host_col, id_col).join(common, ["host", "line"], "left_semi")
            .select(*key, "pos", "words").distinct()  # repeated rows share a key
            .groupBy(*key).agg(F.sum("words").alias("n_common_words")))
    out = base.join(gone, key, "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0)).cast("long"))
    depleted = F.col("n_words") - F.col("n_common_words") < F.lit(min_kept) * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **rules) -> DataFrame:
    """``docs`` without the documents that the rules reject; repeated rows stay or go together, and all
    columns of ``docs`` come back, whatever their names."""
    verdict = quality_rules(docs, id_col=id_col, text_col=text_col, host_col=host_col, **rules)
    x = spare(docs, "_qp")
    stay = verdict.filter("kept").select(F.col("k1").alias(f"{x}1"), F.col("k2").alias(f"{x}2"), F.col("host").alias(f"{x}3"))
    k1, k2 = row_key(id_col, text_col)
    src = docs.withColumns({f"{x}a": k1, f"{x}b": k2, f"{x}c": host(F.col(host_col))})
    on = (F.col(f"{x}a") == F.col(f"{x}1")) & (F.col(f"{x}b") == F.col(f"{x}2")) & (F.col(f"{x}c") == F.col(f"{x}3"))
    return src.join(stay, on, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

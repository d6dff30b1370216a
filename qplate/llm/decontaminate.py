"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every run of ``WINDOW`` words is a winnowing window over its k-grams of ``GRAM`` words: the k-gram with the least
hash (the first of equals) is its fingerprint, so equal windows choose equal fingerprints at equal places and
no shared window is missed.  Documents keep their chosen k-grams, which meet those of the benchmark's
windows; a hit is then extended: the document's windows around it are compared word by word.

An item of fewer words, but not none, is one window; for the few lengths that occur, documents offer
all their k-grams of that length.  NULL and empty texts have no words.  Repeated rows get the same result each;
equal windows of several items count for each item; empty tables give no rows, or documents without hits.  Hits do not
depend on item ids: items with a NULL id count together as one item, which adds nothing to the hashed list of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qplate.llm.common import let, row_key, spare

WINDOW, GRAM = 10, 5
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACE = 31  # bits of a word's place behind 32 bits of hash


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; everything above ASCII belongs to words."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, -1), lambda w: w != "")


def _grams(w: Column, size: int) -> Column:
    """hash32 << PLACE | place of every run of ``size`` words (an empty array for shorter texts)."""
    n = F.size(w) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.shiftleft(
        F.xxhash64(F.lit(size), *[F.get(w, i + j) for j in range(size)]).bitwiseAND((1 << 32) - 1), PLACE).bitwiseOR(
        i.cast("long")))).otherwise(F.array().cast("array<long>"))


def winnow(w: Column) -> Column:
    """The chosen k-gram of each window, in order, one entry for a run of windows with the same choice."""
    span = WINDOW - GRAM + 1

    def choose(grams):
        n = F.size(grams) - span
        mins = F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))),
                                          lambda i: F.least(*[F.get(grams, i + j) for j in range(span)]))) \
            .otherwise(F.array().cast("array<long>"))
        return let(mins, lambda m: F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1))))

    return let(_grams(w, GRAM), choose)


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, PLACE)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND((1 << PLACE) - 1).cast("int")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, k1, k2 (row key), n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    The benchmark's fingerprints are counted; up to ``broadcast_rows`` of them (8 bytes each) are broadcast,
    beyond that the fingerprints of both sides are shuffled on their hash.  Later joins are
    shuffled on row keys or whole windows.
    """
    listed = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w")) \
        .filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    windows = (listed.select("item", size.alias("len"), F.explode(let(F.col("w"), lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - WINDOW + 1, F.lit(1))), lambda i: F.slice(w, i, WINDOW)))).alias("v"))
        .groupBy("len", F.array_join("v", " ").alias("window")).agg(F.collect_set(F.struct("item")).alias("items")))  # a bare NULL would be skipped
    short = sorted(r["len"] for r in windows.filter(F.col("len") < WINDOW).select("len").distinct().collect())  # nine at most
    own = F.split("window", " ", -1)
    prints = windows.select("len", F.when(F.col("len") == WINDOW, F.get(winnow(own), F.lit(0))).otherwise(
        _short_gram(own)).alias("p")).select("len", _hash(F.col("p")).alias("h")).distinct()
    few = prints.limit(broadcast_rows + 1).count() <= broadcast_rows

    key = row_key(id_col, text_col)

    def of_length(n: int, grams: Column) -> Column:
        return F.transform(grams, lambda p: F.struct(F.lit(n).alias("len"), p.alias("p")))

    offered = let(words(F.col(text_col)), lambda w: F.concat(
        of_length(WINDOW, winnow(w)), *[of_length(n, _grams(w, n)) for n in short]))
    chosen = docs.select(*key, F.explode(offered).alias("f")).select(
        "k1", "k2", F.col("f.len").alias("len"), _hash(F.col("f.p")).alias("h"), _place(F.col("f.p")).alias("at"))
    met = chosen.join(F.broadcast(prints) if few else prints, ["len", "h"], "left_semi")

    # extension: the windows that may have chosen a met k-gram, as whole strings of the document's words
    places = met.groupBy("k1", "k2").agg(F.collect_set(F.struct("len", "at")).alias("met"))
    texts = docs.select(*key, F.col(text_col).alias("text")).join(places, ["k1", "k2"]) \
        .select("k1", "k2", let(words(F.col("text")), lambda w: _around(w, F.col("met"))).alias("around"))
    tried = texts.select("k1", "k2", F.explode("around").alias("c")) \
        .select("k1", "k2", "c.len", "c.start", "c.window").distinct()
    hits = tried.join(windows, ["len", "window"]).select("k1", "k2", "len", "start", "items")
    spans = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"))
    found = hits.select("k1", "k2", F.explode("items").alias("i")).select("k1", "k2", "i.item").distinct() \
        .groupBy("k1", "k2").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    result = spans.join(found, ["k1", "k2"]).select(
        "k1", "k2", _covered(F.col("spans")).alias("n_hit"), "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    base = docs.select(F.col(id_col).alias("doc_id"), *key, F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    out = base.join(result, ["k1", "k2"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "k1", "k2", "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
                      F.coalesce("n_items", zero).alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                      (F.coalesce("n_hit", zero) > 0).alias("contaminated"))


def _short_gram(own: Column) -> Column:
    """The only k-gram of an item shorter than a window."""
    out = F.lit(None).cast("long")
    for n in range(1, WINDOW):
        out = F.when(F.size(own) == n, F.get(_grams(own, n), F.lit(0))).otherwise(out)
    return out


def _around(w: Column, met: Column) -> Column:
    """(len, start, window) of the windows that contain a met k-gram where they may have chosen it."""
    back = WINDOW - GRAM
    starts = F.flatten(F.transform(met, lambda m: F.when(m["len"] < WINDOW, F.array(F.struct(m["len"], m["at"].alias("start"))))
                                   .otherwise(F.transform(F.sequence(F.lit(0), F.lit(back)),
                                                          lambda b: F.struct(m["len"], (m["at"] - b).alias("start"))))))
    inside = F.filter(starts, lambda s: (s["start"] >= 0) & (s["start"] + s["len"] <= F.size(w)))
    return F.transform(inside, lambda s: F.struct(s["len"], s["start"],
                                                  F.array_join(F.slice(w, s["start"] + 1, s["len"]), " ").alias("window")))


def _covered(spans: Column) -> Column:
    """Words covered by spans sorted by (start, len)."""
    zero = F.lit(0).cast("long")
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(zero, s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).cast("long").alias("n"),
        F.greatest(a["end"], s["start"] + s["len"]).cast("long").alias("end"))
    return F.aggregate(spans, F.struct(zero.alias("n"), zero.alias("end")), step, lambda a: a["n"])


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` without the documents that share a window with the benchmark; all their columns come back, whatever their names."""
    x = spare(docs, "_qp")
    bad = decontaminate(docs, items, id_col, text_col, **names).filter("contaminated") \
        .select(F.col("k1").alias(f"{x}1"), F.col("k2").alias(f"{x}2"))
    k1, k2 = row_key(id_col, text_col)
    src = docs.withColumns({f"{x}a": k1, f"{x}b": k2})
    on = (F.col(f"{x}a") == F.col(f"{x}1")) & (F.col(f"{x}b") == F.col(f"{x}2"))
    return src.join(bad, on, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

"""Line dedup by site-relative frequency: lines that more than a given ratio of a host's pages carry are dropped.

Pages are grouped by host; a line's page count (pages with equal texts count once) is divided by the
host's page total.  Lines are compared in lower case with white space collapsed; lines without a word
always stay.  NULL text stays NULL, NULL hosts form one host, repeated rows get the same result, an
empty table gives no rows, and a page may end up empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qplate.llm.common import let, row_key, spare
from qplate.llm.lines import common_lines, host, host_lines, normal, split_lines


def drop_common_lines(docs: DataFrame, min_docs: int = 2, ratio: float = 0.05, id_col: str = "doc_id",
                      text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` with ``text_col`` cleaned in place and new columns n_lines and n_removed (in place of any of these names; all other
    columns come back).

    One shuffle of (host, line, text) hashes counts, one joins the common lines to the pages that
    have them, and the texts are shuffled once by row key to meet the hashes of their common lines.
    """
    common = common_lines(docs, text_col, host_col, id_col, min_docs, ratio).select("host", "line")
    x = spare(docs, "_qp")
    marked = (host_lines(docs, text_col, host_col, id_col).join(common, ["host", "line"], "left_semi")
              .groupBy("k1", "k2", "host").agg(F.collect_set("line").alias(f"{x}drop"))
              .select(F.col("k1").alias(f"{x}1"), F.col("k2").alias(f"{x}2"), F.col("host").alias(f"{x}3"), f"{x}drop"))
    k1, k2 = row_key(id_col, text_col)
    src = docs.withColumns({f"{x}a": k1, f"{x}b": k2, f"{x}c": host(F.col(host_col))})
    on = (F.col(f"{x}a") == F.col(f"{x}1")) & (F.col(f"{x}b") == F.col(f"{x}2")) & (F.col(f"{x}c") == F.col(f"{x}3"))
    joined = src.join(marked, on, "left")
    drop = F.coalesce(f"{x}drop", F.array().cast("array<long>"))
    parts = let(split_lines(F.col(text_col)), lambda lines: let(
        F.filter(lines, lambda s: ~(F.array_contains(drop, F.xxhash64(normal(s))) & (normal(s) != ""))),
        lambda left: F.struct(F.array_join(left, "\n").alias("text"), F.size(lines).alias("n"), F.size(left).alias("m"))))
    clean = joined.withColumn(f"{x}p", F.when(F.col(f"{x}drop").isNotNull(), parts))
    n = F.coalesce(F.col(f"{x}p.n"), F.size(split_lines(F.col(text_col))))
    out = [F.when(F.col(f"{x}p").isNotNull(), F.col(f"{x}p.text")).otherwise(F.col(text_col)).alias(text_col)
           if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return clean.select(*out, n.cast("long").alias("n_lines"),
                        F.coalesce(F.col(f"{x}p.n") - F.col(f"{x}p.m"), F.lit(0)).cast("long").alias("n_removed"))

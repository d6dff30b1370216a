"""Line statistics of hosts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qplate.llm.common import row_key

SPACES = "[\\x20\\x09-\\x0D]+"  # ASCII white space


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def normal(line: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), SPACES, " "))


def host(source: Column) -> Column:
    """NULL hosts form one host of their own, apart from the empty name."""
    return F.coalesce(F.concat(F.lit("h:"), source), F.lit("null"))


def host_lines(docs: DataFrame, text_col: str, host_col: str, id_col: str) -> DataFrame:
    """One row per line with a word: k1, k2, host (row key), pos, line (hash of the normalised line), words."""
    key = row_key(id_col, text_col)
    lines = docs.select(*key, host(F.col(host_col)).alias("host"),
                        F.posexplode(split_lines(F.col(text_col))).alias("pos", "raw")) \
        .select("k1", "k2", "host", "pos", normal(F.col("raw")).alias("norm")).filter(F.col("norm") != "")
    return lines.select("k1", "k2", "host", "pos", F.xxhash64("norm").alias("line"),
                        (F.length("norm") - F.length(F.translate("norm", " ", "")) + 1).alias("words"))


def common_lines(docs: DataFrame, text_col: str, host_col: str, id_col: str, min_docs: int, ratio: float) -> DataFrame:
    """(host, line, n_docs, n_host): lines in more than ``ratio`` of a host's documents; ``min_docs`` is the least support that
    makes a share one (on two documents, so that a host's only page does not lose all its lines).

    Documents with equal texts count once, so that copies do not make their lines common.  Counting goes
    through (host, line, text) first, so a hot host or line is spread over its texts and sums
    are combined before the shuffle.
    """
    lines = host_lines(docs, text_col, host_col, id_col)
    per_line = lines.select("host", "line", "k2").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")) \
        .filter(F.col("n_docs") >= min_docs)
    per_host = docs.select(host(F.col(host_col)).alias("host"), F.xxhash64(text_col).alias("k2")).distinct() \
        .groupBy("host").agg(F.count("*").alias("n_host"))
    return per_line.join(per_host, "host").filter(F.col("n_docs") > F.lit(ratio) * F.col("n_host"))

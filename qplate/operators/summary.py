"""Sample-level summary, z-scores and report assembly.

``sample_summary``: per (sample, gene), mean and sample sd of the normalized
and log2 values over rows flagged GOOD.  Missing values poison the group like
indexing with a mask that contains NA would: if any row has a NULL flag, or a
GOOD row has a NULL value, that statistic is NULL.  The statistics sit on the
sample's representative row: the row of the first replicate by name (then
arrival order).

``zscore``: (x - mean) / sd over (zscoring_group, gene), missing removed;
sd NULL or 0 -> NULL.  Low-cardinality keys: a partial ``groupBy().agg()``
plus a join back, never a window over the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qplate.functions.numeric import safe_div
from qplate.operators._util import join_keys

SAMPLE_KEYS = ("sample_name", "Gene")
ZKEYS = ("zscoring_group", "Gene")


def sample_summary(bio: DataFrame, keys: Sequence[str] = SAMPLE_KEYS,
                   values: Sequence[tuple[str, str]] = (("normalized_expression", "normalized_expression"),
                                                         ("log2_expression_value", "log2_expression_value")),
                   flag: str = "qc_flag",
                   representative: Sequence[str] = ("replicate_name", "well_ord", "file_name", "Pos",
                                                    "zscoring_group", "testing_group", "type_of_gene")) -> DataFrame:
    """One row per (keys) with the representative's columns and <out>_mean / <out>_sd per value."""
    good = F.col(flag) == "GOOD"
    aggs = [F.min(F.struct(*[F.col(c) for c in representative])).alias("_rep")]
    for src, out in values:
        x = F.col(src)
        poison = F.max(F.when(F.col(flag).isNull() | (good & x.isNull()), 1).otherwise(0))
        aggs += [poison.alias(f"_poison_{out}"),
                 F.avg(F.when(good, x)).alias(f"_mean_{out}"),
                 F.stddev_samp(F.when(good, x)).alias(f"_sd_{out}")]
    g = bio.groupBy(*keys).agg(*aggs)
    cols = [F.col(k) for k in keys] + [F.col(f"_rep.{c}").alias(c) for c in representative]
    for _, out in values:
        ok = F.col(f"_poison_{out}") == 0
        cols += [F.when(ok, F.col(f"_mean_{out}")).alias(f"{out}_mean"),
                 F.when(ok, F.col(f"_sd_{out}")).alias(f"{out}_sd")]
    return g.select(*cols)


def zscore(df: DataFrame, keys: Sequence[str] = ZKEYS, value: str = "log2_expression_value_mean",
           out: str = "zscored_value") -> DataFrame:
    """Adds ``out`` = (value - group mean) / group sd (missing removed; NULL when sd is NULL or 0)."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_zmu"), F.stddev_samp(value).alias("_zsd"))
    j = join_keys(df, stats, keys, "left")
    return j.withColumn(out, safe_div(F.col(value) - F.col("_zmu"), F.col("_zsd"))).drop("_zmu", "_zsd")

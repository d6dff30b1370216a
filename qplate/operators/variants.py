"""Variant analyses: delta-delta Ct and sample labels derived from names.

``delta_delta`` (intent of the Cp-ratio variant): per (sample, gene) mean of
deltaCT; per (cell line, gene) the mean of those sample means over control
rows (row-weighted); ddCT = deltaCT - control mean; 2^-ddCT; mean/sd of that
over GOOD rows per (cell line, sample group, gene), shown on the first row of
each group.  Missing values propagate like unguarded means (a missing input
makes the statistic missing).

``sample_labels``: sample = replicate name without its last ``.suffix``;
cell type = sample without a final "any character + one digit" and without
everything from the first dot; condition = "Control" when the name contains
"DN", else "Res".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qplate.functions.wells import sample_from_replicate
from qplate.operators._util import join_keys

# Fixed values of the labelling rule.
CONTROL_MARK = "DN"
CONTROL_LABEL, OTHER_LABEL = "Control", "Res"


def _strict_mean(x) -> tuple:
    """(mean, poisoned) pair of aggregates: mean is NULL if any input is NULL (no na.rm)."""
    return F.avg(x), F.max(F.when(x.isNull(), 1).otherwise(0))


def delta_delta(df: DataFrame, control: str, sample: str = "sample_name", cell_line: str = "cell_line",
                group: str = "sample_group", gene: str = "Gene", value: str = "deltaCT",
                flag: str = "qc_flag", order: str = "well_ord", ordered: bool = False) -> DataFrame:
    x = F.col(value)
    m, poison = _strict_mean(x)
    s = df.groupBy(sample, gene).agg(m.alias("_sm"), poison.alias("_sp"))
    d = join_keys(df, s, [sample, gene])
    d = d.withColumn("deltaCT_mean", F.when(F.col("_sp") == 0, F.col("_sm"))).drop("_sm", "_sp")
    is_ctl = F.col(group) == F.lit(control)
    c = d.groupBy(cell_line, gene).agg(
        F.avg(F.when(is_ctl, F.col("deltaCT_mean"))).alias("_cm"),
        F.max(F.when(F.col(group).isNull() | (is_ctl & F.col("deltaCT_mean").isNull()), 1).otherwise(0)).alias("_cp"))
    d = join_keys(d, c, [cell_line, gene], "left")
    d = d.withColumn("delta_delta_CT", x - F.when(F.col("_cp") == 0, F.col("_cm"))).drop("_cm", "_cp")
    d = d.withColumn("elevated_value", F.pow(F.lit(2.0), -F.col("delta_delta_CT")))
    good = F.col(flag) == "GOOD"
    ev = F.col("elevated_value")
    g = d.groupBy(cell_line, group, gene).agg(
        F.avg(F.when(good, ev)).alias("_mv"), F.stddev_samp(F.when(good, ev)).alias("_sv"),
        F.max(F.when(F.col(flag).isNull() | (good & ev.isNull()), 1).otherwise(0)).alias("_gp"),
        F.min(order).alias("_first"))
    d = join_keys(d, g, [cell_line, group, gene], "left")
    first = F.col(order) == F.col("_first")
    ok = F.col("_gp") == 0
    out = (d.withColumn("mean_value", F.when(first & ok, F.col("_mv")))
           .withColumn("sd_value", F.when(first & ok, F.col("_sv")))
           .drop("_mv", "_sv", "_gp", "_first", "deltaCT_mean"))
    if ordered:   # sample, then sample group, then gene (nulls last)
        out = out.orderBy(*[F.col(c).asc_nulls_last() for c in (sample, group, gene)])
    return out


def sample_labels(df: DataFrame, replicate: str = "replicate_name") -> DataFrame:
    sample = sample_from_replicate(F.col(replicate))
    cell = F.regexp_replace(F.regexp_replace(sample, r".[0-9]$", ""), r"\..*$", "")
    cond = F.when(sample.contains(CONTROL_MARK), F.lit(CONTROL_LABEL)).otherwise(F.lit(OTHER_LABEL))
    return df.withColumn("sample_name", sample).withColumn("cell_type", cell).withColumn("sample_group", cond)

"""Leave-one-out outlier flags for biological replicates.

For every row i of a group: ``mean_others`` / ``sd_others`` are the mean and
sample sd of the *other* rows' values (missing values removed); ``mean_others``
needs >= 1 other row and ``sd_others`` >= 2 other rows.  ``qc_flag``:

* sd_others missing                      -> 'GOOD'
* own value missing (sd present)          -> NULL
* |x - mean_others| > k * sd_others       -> 'BAD', else 'GOOD'

Scale design: rows are hash-salted into ``ceil(n / chunk_rows)`` chunks per
group.  Inside a chunk, prefix and suffix windows (two growing frames, never a
shrinking one) give the statistics of the rows before and after i.  The other
chunks come as one summary per (group, chunk), made by prefix and suffix scans
over the chunk table (see ``complements``), so a row costs the same in a group of
any size.  Disjoint summaries are combined with Chan's pairwise merge: no
subtraction of large sums happens, and a group never sits whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qplate.functions.numeric import chan_merge
from qplate.operators._util import join_keys


def _summary(n: F.Column, mean: F.Column, var: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    n = F.coalesce(n, F.lit(0)).cast("long")
    m2 = F.when(n >= 2, var * (n - 1).cast("double")).when(n == 1, F.lit(0.0))
    return n, F.when(n > 0, mean), m2


def leave_one_out(df: DataFrame, keys: Sequence[str], value: str, row_order: Sequence[str],
                  chunk_rows: int = 4096) -> DataFrame:
    """Adds ``_rows`` (group row count), ``_o_n``, ``_o_mean``, ``_o_m2`` (others' non-null summary)."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if (sizes.agg(F.max("_rows")).first()[0] or 0) <= chunk_rows:  # every group is one chunk: its windows are all there is to do
        return _inside(df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys))), keys, value, row_order)
    d = join_keys(df, sizes, keys)
    salts = F.greatest(F.lit(1), F.ceil(F.col("_rows") / F.lit(float(chunk_rows)))).cast("long")
    part = [*keys, "_chunk"]
    d = _inside(d.withColumn("_chunk", F.pmod(F.xxhash64(*[F.col(c) for c in row_order]), salts)), part, value, row_order)
    x = F.col(value)
    chunks = d.groupBy(*part).agg(F.count(x).alias("_cn"), F.avg(x).alias("_cm"), F.var_samp(x).alias("_cv"))
    cn, cm, cq = _summary(F.col("_cn"), F.col("_cm"), F.col("_cv"))
    chunks = chunks.select(*part, cn.alias("n"), cm.alias("mean"), cq.alias("m2"))
    rest = complements(chunks, keys, "_chunk").select(*part, *[F.col(c).alias(f"_r{i}") for i, c in enumerate(_OTHERS)])
    n, mean, m2 = chan_merge((F.col("_o_n"), F.col("_o_mean"), F.col("_o_m2")), (F.col("_r0"), F.col("_r1"), F.col("_r2")))
    kept = [c for c in d.columns if c not in ("_chunk", "_o_n", "_o_mean", "_o_m2")]
    return join_keys(d, rest, part).select(*kept, n.alias("_o_n"), mean.alias("_o_mean"), m2.alias("_o_m2"))


def _inside(d: DataFrame, part: Sequence[str], value: str, row_order: Sequence[str]) -> DataFrame:
    """Adds the summary (``_o_n``, ``_o_mean``, ``_o_m2``) of the other rows of ``part``: those before merged with those behind."""
    x = F.col(value)
    w_pre = Window.partitionBy(*part).orderBy(*[F.col(c).asc() for c in row_order]) \
        .rowsBetween(Window.unboundedPreceding, -1)
    w_suf = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in row_order]) \
        .rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*",
                 *[e.alias(f"_p{i}") for i, e in enumerate(_summary(F.count(x).over(w_pre), F.avg(x).over(w_pre),
                                                                      F.var_samp(x).over(w_pre)))],
                 *[e.alias(f"_s{i}") for i, e in enumerate(_summary(F.count(x).over(w_suf), F.avg(x).over(w_suf),
                                                                      F.var_samp(x).over(w_suf)))])
    # merges are staged as columns so each expression tree stays small
    n, mean, m2 = chan_merge((F.col("_p0"), F.col("_p1"), F.col("_p2")), (F.col("_s0"), F.col("_s1"), F.col("_s2")))
    staged = {f"_{k}{i}" for k in "ps" for i in range(3)}
    return d.select(*[c for c in d.columns if c not in staged], n.alias("_o_n"), mean.alias("_o_mean"), m2.alias("_o_m2"))


_OTHERS = ("o_n", "o_mean", "o_m2")
BLOCK_CHUNKS = 4096  # chunk summaries a window of the first level


def _scanned(table: DataFrame, part: Sequence[str], order: Column, side: str) -> DataFrame:
    """Adds the summary (``<side>_n``, ``_mean``, ``_m2``) of the rows of ``part`` that come before each one in ``order``.

    This is the running form of Chan's merge: taking in a summary adds its own m2 and n * N / (n + N) * (mean - M)^2, where N and M
    are those of the rows before it.  All terms are positive, so they are summed by a window without cancellation.
    """
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n, mean = F.col("n").cast("double"), F.coalesce(F.col("mean"), F.lit(0.0))
    d = table.withColumn(f"{side}_n", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")) \
        .withColumn(f"{side}_mean", F.try_divide(F.sum(n * mean).over(before), F.sum(n).over(before)))
    ahead = F.col(f"{side}_n").cast("double")
    step = F.coalesce(F.col("m2"), F.lit(0.0)) + F.when((ahead > 0) & (n > 0), n * ahead / (n + ahead) * (mean - F.col(f"{side}_mean")) ** 2) \
        .otherwise(F.lit(0.0))
    d = d.withColumn("_step", step)
    return d.withColumn(f"{side}_m2", F.when(F.col(f"{side}_n") > 0, F.sum("_step").over(before))).drop("_step")


def _without_own(table: DataFrame, part: Sequence[str], unit: str) -> DataFrame:
    """Adds the summary of all other rows of ``part`` as (o_n, o_mean, o_m2): those before merged with those behind."""
    d = _scanned(_scanned(table, part, F.col(unit).asc(), "_b"), part, F.col(unit).desc(), "_a")
    merged = chan_merge(*[(F.col(f"{s}_n"), F.col(f"{s}_mean"), F.col(f"{s}_m2")) for s in ("_b", "_a")])
    return d.select(*table.columns, *[m.alias(c) for m, c in zip(merged, _OTHERS)])


def complements(chunks: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """For each (keys, unit) of a table of summaries (n, mean, m2): the summary (o_n, o_mean, o_m2) of all its group's other units.

    Two levels: units are scanned inside blocks of ``BLOCK_CHUNKS``, the blocks of a group inside the group.
    """
    keys = list(keys)
    d = _without_own(chunks.withColumn("_block", F.floor(F.col(unit) / BLOCK_CHUNKS)), [*keys, "_block"], unit)
    # a block is any of its units merged with the others of the block
    whole = chan_merge((F.col("n"), F.col("mean"), F.col("m2")), (F.col("o_n"), F.col("o_mean"), F.col("o_m2")))
    first = F.min(F.struct(F.col(unit), *[e.alias(c) for e, c in zip(whole, ("n", "mean", "m2"))])).alias("s")
    blocks = d.groupBy(*keys, "_block").agg(first).select(*keys, "_block", "s.n", "s.mean", "s.m2")
    outside = _without_own(blocks, keys, "_block").select(*keys, "_block", *[F.col(c).alias(f"_x{i}") for i, c in enumerate(_OTHERS)])
    d = join_keys(d, outside, [*keys, "_block"])
    merged = chan_merge((F.col("o_n"), F.col("o_mean"), F.col("o_m2")), (F.col("_x0"), F.col("_x1"), F.col("_x2")))
    return d.select(*keys, unit, *[m.alias(c) for m, c in zip(merged, _OTHERS)])


def loo_outliers(df: DataFrame, keys: Sequence[str] = ("sample_name", "Gene"),
                 value: str = "normalized_expression", k: float = 2.5,
                 row_order: Sequence[str] = ("replicate_name", "well_ord"), chunk_rows: int = 4096) -> DataFrame:
    """Adds mean_others, sd_others, qc_flag (see module doc)."""
    d = leave_one_out(df, keys, value, row_order, chunk_rows)
    others_rows = F.col("_rows") - 1
    mean_o = F.when((others_rows >= 1) & (F.col("_o_n") >= 1), F.col("_o_mean"))
    sd_o = F.when((others_rows >= 2) & (F.col("_o_n") >= 2),
                  F.sqrt(F.greatest(F.col("_o_m2"), F.lit(0.0)) / (F.col("_o_n") - 1).cast("double")))
    d = d.withColumn("mean_others", mean_o).withColumn("sd_others", sd_o)
    x = F.col(value)
    flag = (F.when(F.col("sd_others").isNull(), F.lit("GOOD"))
            .when(x.isNull(), F.lit(None).cast("string"))
            .when(F.abs(x - F.col("mean_others")) > F.lit(float(k)) * F.col("sd_others"), F.lit("BAD"))
            .otherwise(F.lit("GOOD")))
    return d.withColumn("qc_flag", flag).drop("_rows", "_o_n", "_o_mean", "_o_m2")

"""Replicate-level quality control.

* ``drop_failed_replicates`` - a replicate fails when any housekeeping well has
  a numeric Cp >= threshold (blank Cp never fails it; the test runs before the
  blank fill).
* ``fill_undetected`` - blank Cp -> threshold.
* ``technical_qc`` - per (replicate, gene) technical group: every well is
  compared with every other well of its group (``|Cp_a - Cp_b| <= tol`` on
  doubles); ``valid`` = number of good comparisons.  all good -> keep all; all
  bad -> keep all; mixed -> keep wells with ``valid >= n - slack``.

Scale design of ``technical_qc``: wells with the same (group, Cp) are identical
for the rule, so the work runs on the *distinct values* table (pre-aggregated
map-side, one row per (group, Cp) with its multiplicity).  The number of group
members within the tolerance band of each value comes from RANGE windows over
value-chunked partitions ``(group, floor(Cp / W))`` with halo rows copied into
the neighbouring chunk, so a hot replicate is split across many tasks and no
pair list is ever built.  The band count is exact for the double predicate:
a core frame counts values that surely pass, and two thin shell frames of width
2*EPS at the band edges are checked with the literal ``abs(a - b) <= tol``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qplate.operators._util import join_keys, materialize

GROUP = ("replicate_name", "Gene")
# Shell half-width around the band edge; exact while ulp(|Cp|) << EPS (|Cp| < 1e8).
EPS = 1e-6


def failed_replicates(wells: DataFrame, threshold: float = 35.0) -> DataFrame:
    """Distinct replicate names with a housekeeping Cp >= threshold (partial aggregation, tiny output)."""
    return (wells.filter((F.col("type_of_gene") == "HK") & (F.col("Cp") >= F.lit(threshold)))
            .select("replicate_name").distinct())


def drop_failed_replicates(wells: DataFrame, threshold: float = 35.0, drop: bool = True) -> DataFrame:
    """Remove (or, with ``drop=False``, only flag) replicates whose HK wells failed.

    Adds ``good_replicate`` ('good' / 'bad').  The failed set is one row per
    replicate; AQE broadcasts it at run time when small, otherwise the anti
    join is a skew-split sort-merge join.
    """
    bad = failed_replicates(wells, threshold)
    if drop:
        return wells.join(bad, "replicate_name", "left_anti").withColumn("good_replicate", F.lit("good"))
    flagged = bad.withColumn("_failed", F.lit(True))
    return (wells.join(flagged, "replicate_name", "left")
            .withColumn("good_replicate", F.when(F.col("_failed"), "bad").otherwise("good"))
            .drop("_failed"))


def fill_undetected(wells: DataFrame, value: float = 35.0, col: str = "Cp") -> DataFrame:
    return wells.withColumn(col, F.coalesce(F.col(col), F.lit(float(value))))


def distinct_values(wells: DataFrame, keys: Sequence[str] = GROUP, cp: str = "Cp",
                    carry: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, Cp) with multiplicity ``m``; pre-aggregated before the shuffle.

    With ``carry``, ``_first`` holds the earliest well (by ``well_ord``) of that
    value as a struct (well_ord, *carry): the group representative is the min of these.
    """
    aggs = [F.count(F.lit(1)).alias("m")]
    if carry:
        aggs.append(F.min(F.struct(F.col("well_ord"), *[F.col(c) for c in carry])).alias("_first"))
    return wells.groupBy(*keys, cp).agg(*aggs)


def band_counts(values: DataFrame, keys: Sequence[str] = GROUP, cp: str = "Cp",
                tol: float = 0.5, chunk_width: float | None = None) -> DataFrame:
    """For each distinct (keys, cp): ``c`` = number of group wells x with abs(x - cp) <= tol.

    ``values`` holds (keys, cp, m).  Exact and skew-safe (see module doc).
    """
    if tol < 0:
        raise ValueError("tolerance must be >= 0")
    W = float(chunk_width or max(8.0 * tol, 1.0))
    extra = [c for c in values.columns if c not in (*keys, cp, "m")]
    inner = max(tol - EPS, 0.0)
    outer = tol + EPS
    halo = outer + EPS
    own = F.floor(F.col(cp) / W)
    chunks = F.sequence(F.floor((F.col(cp) - halo) / W), F.floor((F.col(cp) + halo) / W))
    expanded = (values.withColumn("_own", own)
                .withColumn("_chunk", F.explode(chunks)))
    part = ", ".join(f"`{k}`" for k in keys) + ", _chunk"
    o = f"ORDER BY `{cp}`"

    def frame(lo: str, hi: str) -> str:
        return f"OVER (PARTITION BY {part} {o} RANGE BETWEEN {lo} AND {hi})"

    le_hi = F.expr(f"sum(m) {frame('UNBOUNDED PRECEDING', f'CAST({inner!r} AS DOUBLE) FOLLOWING')}")
    le_lo = F.expr(f"sum(m) {frame('UNBOUNDED PRECEDING', f'CAST({inner!r} AS DOUBLE) PRECEDING')}")
    sh_lo = F.expr(f"collect_list(named_struct('x', `{cp}`, 'm', m)) "
                   f"{frame(f'CAST({outer!r} AS DOUBLE) PRECEDING', f'CAST({inner!r} AS DOUBLE) PRECEDING')}")
    sh_hi = F.expr(f"collect_list(named_struct('x', `{cp}`, 'm', m)) "
                   f"{frame(f'CAST({inner!r} AS DOUBLE) FOLLOWING', f'CAST({outer!r} AS DOUBLE) FOLLOWING')}")
    v = F.col(cp)
    # lower shell holds only x <= v - inner (outside the core); upper shell may repeat x == v + inner
    lo_pass = F.aggregate(F.filter(F.col("_sl"), lambda s: F.abs(s["x"] - v) <= F.lit(tol)),
                          F.lit(0).cast("long"), lambda acc, s: acc + s["m"])
    hi_pass = F.aggregate(F.filter(F.col("_sh"), lambda s: (s["x"] > v + F.lit(inner)) & (F.abs(s["x"] - v) <= F.lit(tol))),
                          F.lit(0).cast("long"), lambda acc, s: acc + s["m"])
    counted = (expanded
               .select(*keys, cp, "m", *extra, "_own", "_chunk",
                       le_hi.alias("_le_hi"), F.coalesce(le_lo, F.lit(0)).alias("_le_lo"),
                       sh_lo.alias("_sl"), sh_hi.alias("_sh"))
               .filter(F.col("_chunk") == F.col("_own")))
    return counted.select(*keys, cp, "m", *extra,
                          (F.col("_le_hi") - F.col("_le_lo") + lo_pass + hi_pass).alias("c"))


def technical_qc_values(wells: DataFrame, tol: float = 0.5, slack: int = 2,
                        keys: Sequence[str] = GROUP, cp: str = "Cp",
                        chunk_width: float | None = None, carry: Sequence[str] = (), pin: str = "none") -> DataFrame:
    """Value-level technical QC: (keys, cp, m, valid_counter, n_of_samples, group_type, keep_this_value[, _first])."""
    return qc_from_values(distinct_values(wells, keys, cp, carry), tol, slack, keys, cp, chunk_width, pin)


def qc_from_values(vals: DataFrame, tol: float = 0.5, slack: int = 2, keys: Sequence[str] = GROUP,
                   cp: str = "Cp", chunk_width: float | None = None, pin: str = "none",
                   drop_failed: bool | None = None, null_safe: bool = True) -> DataFrame:
    """Keep flags from a distinct-value table (keys, cp, m, extra columns passed through).

    The band-count table feeds the failed-replicate screen, the group
    statistics and the join back; ``pin`` (see ``materialize``) writes it once
    so no branch recomputes it.  When ``vals`` carries ``_fail`` (from
    ``screened_values``) the screen runs here, on the pinned table: technical
    groups never span replicates, so screening after counting changes nothing
    for the replicates that stay.  ``drop_failed`` False flags instead of dropping.
    """
    counted = materialize(band_counts(vals, keys, cp, tol, chunk_width), pin)
    if "_fail" in counted.columns:
        bad = counted.filter(F.col("_fail") == 1).select("replicate_name").distinct()
        if drop_failed is None or drop_failed:
            counted = counted.join(bad, "replicate_name", "left_anti").withColumn("good_replicate", F.lit("good"))
        else:
            counted = (counted.join(bad.withColumn("_bad", F.lit(True)), "replicate_name", "left")
                       .withColumn("good_replicate", F.when(F.col("_bad"), "bad").otherwise("good")).drop("_bad"))
        counted = counted.drop("_fail")
    stats = counted.groupBy(*keys).agg(
        F.sum("m").alias("n_of_samples"), F.min("c").alias("_cmin"), F.max("c").alias("_cmax"))
    j = join_keys(counted, stats, keys, null_safe=null_safe)
    valid = F.col("c") - F.lit(1)
    group_type = (F.when(F.col("_cmin") == F.col("n_of_samples"), "all_good")
                  .when(F.col("_cmax") == 1, "all_bad").otherwise("mixed"))
    keep = F.when(group_type.isin("all_good", "all_bad") | (valid >= F.col("n_of_samples") - F.lit(slack)), "keep") \
        .otherwise("NO keep")
    extra = [c for c in counted.columns if c not in (*keys, cp, "m", "c")]
    return j.select(*keys, cp, "m", valid.alias("valid_counter"), "n_of_samples",
                    group_type.alias("group_type"), keep.alias("keep_this_value"), *extra)


def screened_values(wells: DataFrame, threshold: float = 35.0, keys: Sequence[str] = GROUP,
                    cp: str = "Cp", carry: Sequence[str] = ()) -> DataFrame:
    """Blank fill and distinct-value aggregation in one pass over the wells, carrying the
    failed-replicate evidence.

    Groups by the *filled* Cp while carrying ``_fail`` = whether any raw HK Cp of
    the value reached the threshold (blank wells never fail a replicate), so the
    wells are scanned once; ``qc_from_values`` derives the failed-replicate set
    from the much smaller value table.
    """
    raw = F.col(cp)
    filled = wells.withColumn("_fail", F.when((F.col("type_of_gene") == "HK") & (raw >= F.lit(threshold)), 1)
                              .otherwise(0)).withColumn(cp, F.coalesce(raw, F.lit(float(threshold))))
    aggs = [F.count(F.lit(1)).alias("m"), F.max("_fail").alias("_fail")]
    if carry:
        aggs.append(F.min(F.struct(F.col("well_ord"), *[F.col(c) for c in carry])).alias("_first"))
    return filled.groupBy(*keys, cp).agg(*aggs)


def technical_qc(wells: DataFrame, tol: float = 0.5, slack: int = 2,
                 keys: Sequence[str] = GROUP, cp: str = "Cp", chunk_width: float | None = None,
                 with_counts: bool = False) -> DataFrame:
    """Well-level technical QC: adds ``keep_this_value`` (and optionally the counters) to every well.

    One join of the wells with the value-level result on (keys, Cp); hot
    (group, Cp) keys are split by AQE's skew-join handling.
    """
    q = technical_qc_values(wells, tol, slack, keys, cp, chunk_width)
    cols = ["keep_this_value"] + (["valid_counter", "n_of_samples", "group_type"] if with_counts else [])
    return join_keys(wells, q.select(*keys, cp, *cols), [*keys, cp], "left")


def screened_technical_qc(wells: DataFrame, threshold: float = 35.0, tol: float = 0.5, slack: int = 2, keys: Sequence[str] = GROUP,
                          cp: str = "Cp", chunk_width: float | None = None, drop_failed: bool = True, pin: str = "table") -> DataFrame:
    """The wells of good replicates, blanks filled, with ``keep_this_value`` and its counters, from wells as read.

    One scan makes the distinct values with the evidence against their replicates; the screen, the band counts and the keep
    rule work on that table, which is written once, and the second scan joins the wells with it.
    """
    values = qc_from_values(screened_values(wells, threshold, keys, cp), tol, slack, keys, cp, chunk_width, pin, drop_failed)
    kept = values.select(*keys, cp, "good_replicate", "valid_counter", "n_of_samples", "group_type", "keep_this_value")
    return join_keys(fill_undetected(wells, threshold, cp), kept, [*keys, cp])

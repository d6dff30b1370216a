"""Skew: one replicate/gene holding most of the wells is split across value chunks and stays exact."""

import numpy as np
from pyspark.sql import functions as F

from qplate.operators.outliers import loo_outliers
from qplate.operators.replicate_qc import band_counts, distinct_values
from qplate.sources.driver_tables import load_table


def test_hot_replicate_band_counts_exact(spark):
    ev = load_table(spark, "/root/testdata/sf0.1", "events")
    # derived from the given table: every event with value >= 1 becomes a well of ONE replicate and gene
    wells = ev.filter(F.col("value") >= 1).select(
        F.lit("HOT.1").alias("replicate_name"), F.lit("G").alias("Gene"),
        (F.lit(20.0) + F.col("value") / 20).alias("Cp"), F.col("event_id").alias("well_ord"))
    vals = distinct_values(wells)
    chunked = vals.withColumn("_chunk", F.floor(F.col("Cp") / 2.0))
    per_chunk = [r["count"] for r in chunked.groupBy("_chunk").count().collect()]
    n_vals = vals.count()
    assert max(per_chunk) < n_vals / 2            # the hot group is spread over many window partitions
    got = band_counts(vals, tol=0.5, chunk_width=2.0).toPandas()
    cps = np.array([r.Cp for r in wells.select("Cp").collect()])
    x = np.sort(got["Cp"].to_numpy())
    expect = {}
    for start in range(0, len(x), 2000):
        blk = x[start:start + 2000]
        expect.update(zip(blk, (np.abs(cps[None, :] - blk[:, None]) <= 0.5).sum(axis=1)))
    assert all(int(expect[cp]) == int(c) for cp, c in zip(got["Cp"], got["c"]))


def test_hot_sample_leave_one_out_chunked(spark):
    ev = load_table(spark, "/root/testdata/sf0.01", "events")
    d = ev.select(F.lit("S").alias("sample_name"), F.lit("G").alias("Gene"),
                  F.col("event_id").cast("string").alias("replicate_name"), F.col("event_id").alias("well_ord"),
                  F.col("value").alias("normalized_expression"))
    a = {r.replicate_name: (r.mean_others, r.sd_others) for r in loo_outliers(d, chunk_rows=64).collect()}
    b = {r.replicate_name: (r.mean_others, r.sd_others) for r in loo_outliers(d, chunk_rows=1 << 30).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert abs(a[k][0] - b[k][0]) <= 1e-9 * abs(b[k][0]) and abs(a[k][1] - b[k][1]) <= 1e-9 * abs(b[k][1])


def test_hot_ranksum_test_matches_pandas_ranks(spark):
    import math

    ev = load_table(spark, "/root/testdata/sf0.01", "events")
    d = ev.select(F.lit("z").alias("zscoring_group"), F.lit("G").alias("Gene"),
                  F.when(F.pmod(F.col("user_id"), F.lit(2)) == 0, "a").otherwise("b").alias("testing_group"),
                  F.col("value").alias("normalized_expression"))
    from qplate.operators.significance import ranksum_test
    r = ranksum_test(d).collect()[0]
    pdf = d.toPandas()
    ranks = pdf["normalized_expression"].rank(method="average")
    a = pdf["testing_group"] == "a"
    n1, n2 = int(a.sum()), int((~a).sum())
    w = ranks[a].sum() - n1 * (n1 + 1) / 2
    t = pdf["normalized_expression"].value_counts()
    ties = float(((t ** 3) - t).sum())
    sigma = math.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))))
    z = (w - n1 * n2 / 2 - math.copysign(0.5, w - n1 * n2 / 2)) / sigma
    assert r.method == "normal" and abs(r.statistic - w) < 1e-6
    assert abs(r.pvalue - math.erfc(abs(z) / math.sqrt(2))) < 1e-9


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_single_scan_and_chunked_windows(spark):
    from qplate.operators.replicate_qc import screened_values
    from qplate.plans.pipeline import CARRY, GROUP
    from qplate.plans.registry import EVENT_CFG, _wells

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        w = _wells(spark, "/root/testdata/sf0.001").filter(F.col("replicate_name").isNotNull())
        vals = screened_values(w, EVENT_CFG.bad_replicate_cp, GROUP, "Cp", CARRY)
        p = _plan(band_counts(vals, tol=EVENT_CFG.tolerance, chunk_width=EVENT_CFG.chunk_width))
        assert p.count("FileScan parquet") == 1                     # the well table is read once
        import re
        exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)", p)
        assert any("_chunk" in e and "replicate_name" in e for e in exchanges)   # windows partition by value chunk
        assert "SortMergeJoin" not in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_report_reads_source_once(spark):
    from qplate.plans.pipeline import analyse
    from qplate.plans.registry import EVENT_CFG, _wells

    a = analyse(_wells(spark, "/root/testdata/sf0.001"), EVENT_CFG)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(a.report(ordered=False))
        assert p.count("sf0.001/events.parquet") == 1
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

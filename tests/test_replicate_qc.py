"""Technical QC: micro-cases and brute-force equivalence of the value-chunked band counts."""

import random

from pyspark.sql import functions as F

from qplate.operators.comparisons import comparison_strings
from qplate.operators.replicate_qc import (
    band_counts,
    distinct_values,
    drop_failed_replicates,
    fill_undetected,
    technical_qc,
)

SCHEMA = "replicate_name string, Gene string, type_of_gene string, well_ord long, Cp double"


def _wells(spark, cps, rep="R1", gene="G"):
    return spark.createDataFrame([(rep, gene, "Normal", i, cp) for i, cp in enumerate(cps)], SCHEMA)


def _keep(spark, cps, tol=0.5):
    out = technical_qc(_wells(spark, cps), tol, 2, with_counts=True).orderBy("well_ord")
    return [(r.valid_counter, r.keep_this_value, r.group_type) for r in out.collect()]


def test_s5_mixed_triple(spark):
    # Cp [20, 25, 20], tol 0.5: the two 20s agree with each other only
    got = _keep(spark, [20.0, 25.0, 20.0])
    assert [k for _, k, _ in got] == ["keep", "NO keep", "keep"]
    assert [v for v, _, _ in got] == [1, 0, 1]


def test_s5_comparison_order(spark):
    # "self" removed is the first equal value; order of the others is arrival order
    out = comparison_strings(_wells(spark, [20.0, 25.0, 20.0]), 0.5).orderBy("well_ord")
    assert [r.comparison_results for r in out.collect()] == ["bad,good", "bad,bad", "bad,good"]


def test_s6_singleton(spark):
    assert _keep(spark, [20.0]) == [(0, "keep", "all_good")]
    out = comparison_strings(_wells(spark, [20.0]), 0.5).collect()
    assert out[0].comparison_results == ""


def test_s7_two_tight_pairs_all_dropped(spark):
    got = _keep(spark, [20.0, 20.2, 25.0, 25.2])
    assert all(k == "NO keep" for _, k, _ in got)


def test_s7_pair_and_outlier(spark):
    got = _keep(spark, [20.0, 20.2, 25.0])
    assert [k for _, k, _ in got] == ["keep", "keep", "NO keep"]


def test_all_bad_group_is_kept(spark):
    got = _keep(spark, [20.0, 22.0, 24.0])
    assert {g for _, _, g in got} == {"all_bad"} and all(k == "keep" for _, k, _ in got)


def test_double_rounding_at_tolerance(spark):
    # 26.94 - 26.44 is not exactly 0.5 in doubles; the rule uses the double difference
    a, b = 26.44, 26.94
    expected_good = abs(b - a) <= 0.5
    got = _keep(spark, [a, b])
    assert got[0][0] == (1 if expected_good else 0)


def test_s2_blank_hk_does_not_fail(spark):
    df = spark.createDataFrame([("R1", "HK1", "HK", 0, None), ("R1", "G", "Normal", 1, 20.0),
                                ("R2", "HK1", "HK", 2, 35.0), ("R2", "G", "Normal", 3, 20.0)], SCHEMA)
    kept = drop_failed_replicates(df, 35.0)
    assert sorted({r.replicate_name for r in kept.collect()}) == ["R1"]
    flagged = drop_failed_replicates(df, 35.0, drop=False)
    assert {(r.replicate_name, r.good_replicate) for r in flagged.collect()} == {("R1", "good"), ("R2", "bad")}
    filled = fill_undetected(kept, 35.0)
    assert sorted(r.Cp for r in filled.collect()) == [20.0, 35.0]


def test_null_gene_is_its_own_group(spark):
    df = spark.createDataFrame([("R1", None, "Normal", 0, 20.0), ("R1", None, "Normal", 1, 20.1),
                                ("R1", "G", "Normal", 2, 30.0)], SCHEMA)
    out = technical_qc(df, 0.5, 2, with_counts=True).orderBy("well_ord").collect()
    assert [r.n_of_samples for r in out] == [2, 2, 1]


def _brute(cps, tol):
    return [sum(1 for y in cps if abs(y - x) <= tol) for x in cps]


def test_band_counts_match_brute_force(spark):
    rng = random.Random(7)
    data, expect = [], {}
    for g in range(30):
        n = rng.choice([1, 2, 3, 5, 12])
        # two-decimal Cps near chunk edges and exact tolerance gaps
        cps = [round(rng.uniform(15.5, 17.5), 2) for _ in range(n)] + [16.0, 16.5, 15.5]
        for i, cp in enumerate(cps):
            data.append((f"R{g}", "G", "Normal", len(data), cp))
        for cp, c in zip(cps, _brute(cps, 0.5)):
            expect[(f"R{g}", cp)] = c
    df = spark.createDataFrame(data, SCHEMA)
    for width in (1.0, 4.0, 0.75):   # small widths force many chunks and halo copies
        got = band_counts(distinct_values(df), tol=0.5, chunk_width=width)
        for r in got.collect():
            assert r.c == expect[(r.replicate_name, r.Cp)], (width, r)


def test_hot_group_split_across_chunks(spark):
    # one replicate holding most rows, spread over many value chunks
    rng = random.Random(3)
    cps = [round(rng.uniform(10, 40), 2) for _ in range(3000)]
    df = spark.createDataFrame([("HOT", "G", "Normal", i, cp) for i, cp in enumerate(cps)], SCHEMA)
    got = {r.Cp: r.c for r in band_counts(distinct_values(df), tol=0.5, chunk_width=2.0).collect()}
    brute = dict(zip(cps, _brute(cps, 0.5)))
    assert got == brute


def test_well_level_join_keeps_every_well(spark):
    df = _wells(spark, [20.0, 20.0, 20.0, 21.0])
    out = technical_qc(df, 0.5, 2)
    assert out.count() == 4
    assert out.filter(F.col("keep_this_value").isNull()).count() == 0


def test_s9_hk_reference_weighted_by_kept_wells(spark):
    import math

    from qplate.operators.expression import group_expression
    from qplate.operators.replicate_qc import technical_qc_values
    five = -math.log2(5.0)                       # 0.5 ** five == 5
    rows = [("R", "H1", "HK", 0, 0.0), ("R", "H1", "HK", 1, 0.0), ("R", "H1", "HK", 2, 0.0),
            ("R", "H2", "HK", 3, five), ("R", "T", "Normal", 4, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    qv = technical_qc_values(df, 0.5, 2, carry=("type_of_gene",))
    g = {r.Gene: r for r in group_expression(qv).collect()}
    assert abs(g["H2"].elevated_value_mean - 5.0) < 1e-12
    # reference = (3 * 1 + 1 * 5) / 4 = 2 (row-weighted), not (1 + 5) / 2 = 3
    assert abs(g["T"].normalized_expression - 0.5 / 2.0) < 1e-12
    assert abs(g["T"].log2_expression_value - math.log2(0.25)) < 1e-12

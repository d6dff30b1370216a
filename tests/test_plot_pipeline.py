"""Plot tables, recalculation invariance and the driver entry points."""

from pyspark.sql import functions as F

from qplate.operators.plotdata import heatmap_matrix, magnitude_breaks, with_r_number
from qplate.plans.pipeline import analyse, recalculate
from qplate.plans.registry import EVENT_CFG, _wells


def test_op19_breaks(spark):
    pts = spark.createDataFrame([("z", v) for v in [0.5, 0.6, 80.0, 90.0]], "zscoring_group string, points_of_plot double")
    got = sorted((r.id, r.up_down, round(r.real_break, 6), r.use_breaks) for r in magnitude_breaks(pts, jump=2).collect())
    assert got == [(2, "DOWN", 0.66, True), (3, "UP", 72.0, True)]


def test_breaks_zero_and_single_decade_between_jumps(spark):
    pts = spark.createDataFrame([("z", v) for v in [0.0, 5.0, 5000.0]], "zscoring_group string, points_of_plot double")
    got = sorted((r.id, r.up_down) for r in magnitude_breaks(pts, jump=2).collect())
    # 0 -> 5 is a jump (log10 0 = -inf); 5 sits between two jumps and is UP only
    assert got == [(1, "DOWN"), (2, "UP"), (3, "UP")]


def test_r_number_text(spark):
    vals = [0.032, 0.0001, 0.00012, 1.2e-05, 1.0, 0.5, 0.001, 12.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r.x: r.t for r in with_r_number(df, "x", "t").collect()}
    assert got == {0.032: "0.032", 0.0001: "1e-04", 0.00012: "0.00012", 1.2e-05: "1.2e-05", 1.0: "1",
                   0.5: "0.5", 0.001: "0.001", 12.0: "12"}


def test_heatmap_pivot(spark):
    long = spark.createDataFrame([("g1", "s1", 1.0), ("g1", "s2", 2.0), ("g2", "s1", 3.0)],
                                 "GENES string, sample_name string, zscore_value double")
    wide = {r.GENES: (r.s1, r.s2) for r in heatmap_matrix(long, ["GENES"], "sample_name", "zscore_value", ["s1", "s2"]).collect()}
    assert wide == {"g1": (1.0, 2.0), "g2": (3.0, None)}


def test_recalculate_without_overrides_reproduces_report(spark):
    a = analyse(_wells(spark, "/root/testdata/sf0.001"), EVENT_CFG)
    rep = a.report(ordered=False)
    again, stats = recalculate(rep, EVENT_CFG)
    cols = ["elevated_value_mean", "normalized_expression", "normalized_expression_mean", "zscored_value", "qc_flag"]
    left = {(r.file_name, r.Pos): tuple(r[c] for c in cols) for r in rep.collect()}
    right = {(r.file_name, r.Pos): tuple(r[c] for c in cols) for r in again.collect()}
    assert left.keys() == right.keys()
    for k, v in left.items():
        w = right[k]
        for x, y in zip(v, w):
            assert (x is None and y is None) or x == y or abs(x - y) <= 1e-9 * max(1.0, abs(x)), (k, v, w)
    s1 = {(r.zscoring_group, r.Gene): r.pvalue for r in a.statistics.collect()}
    s2 = {(r.zscoring_group, r.Gene): r.pvalue for r in stats.collect()}
    assert s1.keys() == s2.keys()


def test_entry_and_registry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["hk_failed_drop"](spark, "/root/testdata/sf0.001").filter(F.col("Cp").isNull()).count() >= 0


def test_null_gene_group_through_analysis(spark):
    # wells with a replicate but no gene form their own group and keep NULL in every output
    rows = []
    for rep in ("A.1", "A.2", "A.3"):
        for i, (gene, typ, cp) in enumerate([("H", "HK", 20.0), ("H", "HK", 20.1), (None, "Normal", 25.0),
                                             (None, "Normal", 25.2), ("T", "Normal", 27.0)]):
            rows.append((f"p_{rep}", f"A{i + 1}", len(rows), rep, "A", "z", "control", gene, typ, cp + 0.1 * len(rows) % 3))
    wells = spark.createDataFrame(rows, "file_name string, Pos string, well_ord long, replicate_name string, "
                                        "sample_name string, zscoring_group string, testing_group string, Gene string, "
                                        "type_of_gene string, Cp double")
    from qplate.config import AnalysisConfig
    a = analyse(wells, AnalysisConfig(hk_genes=("H",)))
    rep = a.report(ordered=False).collect()
    assert len(rep) == 15 and sum(r.Gene is None for r in rep) == 6
    assert {r.Gene for r in a.groups.collect()} == {"H", None, "T"}
    assert {r.Gene for r in a.summary.collect()} == {"H", None, "T"}
    # S-19: the ordered report puts NULL genes last inside each replicate
    ordered = a.report(ordered=True).collect()
    for rep_name in ("A.1", "A.2", "A.3"):
        genes = [r.Gene for r in ordered if r.replicate_name == rep_name]
        first_null = genes.index(None)
        assert all(g is None for g in genes[first_null:]) and genes[:first_null] == sorted(genes[:first_null])


def test_variant_orderings(spark):
    from qplate.operators.variants import delta_delta
    df = spark.createDataFrame(
        [("s2", "c", "DN", "G", 1.0, "GOOD", 0), ("s1", "c", "DN", "G", 2.0, "GOOD", 1), ("s1", "c", "R", "G", 3.0, "GOOD", 2)],
        "sample_name string, cell_line string, sample_group string, Gene string, deltaCT double, qc_flag string, well_ord long")
    out = delta_delta(df, "DN", ordered=True).collect()
    assert [(r.sample_name, r.sample_group) for r in out] == [("s1", "DN"), ("s1", "R"), ("s2", "DN")]
    # sample means per (sample, gene): s1 = (2 + 3) / 2, s2 = 1; control mean over control rows = (1 + 2.5) / 2
    assert abs(out[1].delta_delta_CT - (3.0 - 1.75)) < 1e-12


def test_report_with_comparison_column(spark):
    a = analyse(_wells(spark, "/root/testdata/sf0.001"), EVENT_CFG)
    rep = a.report(with_comparisons=True, ordered=False)
    assert "comparison_results" in rep.columns
    rows = rep.select("comparison_results", "keep_this_value").collect()
    # every well lists n - 1 comparisons; a "keep" in a mixed group has >= n - 2 goods
    sizes = {(r.replicate_name, r.Gene): r.n for r in
             rep.groupBy("replicate_name", "Gene").agg(F.count("*").alias("n")).collect()}
    for r in rep.select("replicate_name", "Gene", "comparison_results").collect():
        n = sizes[(r.replicate_name, r.Gene)]
        parts = [p for p in r.comparison_results.split(",") if p] if r.comparison_results else []
        assert len(parts) == n - 1
    assert len(rows) == rep.count()


def test_s8_representative_may_be_dropped_well(spark):
    from qplate.config import AnalysisConfig
    rows = [("p", "A1", 0, "R.1", "S", "z", "c", "H", "HK", 20.0), ("p", "A2", 1, "R.1", "S", "z", "c", "H", "HK", 20.0),
            ("p", "A3", 2, "R.1", "S", "z", "c", "T", "Normal", 25.0),   # first T well, the outlier
            ("p", "A4", 3, "R.1", "S", "z", "c", "T", "Normal", 20.0), ("p", "A5", 4, "R.1", "S", "z", "c", "T", "Normal", 20.1)]
    wells = spark.createDataFrame(rows, "file_name string, Pos string, well_ord long, replicate_name string, "
                                        "sample_name string, zscoring_group string, testing_group string, Gene string, "
                                        "type_of_gene string, Cp double")
    rep = {r.Pos: r for r in analyse(wells, AnalysisConfig(hk_genes=("H",))).report(ordered=False).collect()}
    assert rep["A3"].keep_this_value == "NO keep"
    expect = (0.5 ** 20.0 + 0.5 ** 20.1) / 2
    assert abs(rep["A3"].elevated_value_mean - expect) <= 1e-12 * expect
    assert rep["A4"].elevated_value_mean is None and rep["A5"].elevated_value_mean is None

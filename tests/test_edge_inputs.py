"""Inputs off the clean path: paths, plate sizes, one-group tests, metadata fan-out, NULL genes, label clashes."""

import os

import pytest
from conftest import rows

from qplate import AnalysisConfig
from qplate.functions.wells import well_index
from qplate.operators.plotdata import plot_points
from qplate.operators.significance import two_group_test
from qplate.plans.pipeline import analyse, recalculate, replay_files
from qplate.sources.plates import read_plates, read_sheet

WELLS = ("file_name string, Pos string, well_ord long, replicate_name string, sample_name string, zscoring_group string, "
         "testing_group string, Gene string, type_of_gene string, Cp double")


def _export(folder, name, positions):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.txt")
    with open(path, "w", newline="") as fh:
        fh.write("Experiment: x\r\nInclude\tColor\tPos\tName\tCp\tConcentration\tStandard\tStatus\r\n")
        for p in positions:
            fh.write(f"True\t255\t{p}\tSample\t26,4\t\t0\t\r\n")
    return path


def test_any_spelling_of_paths_gives_unique_ordinals(spark, tmp_path):
    a, b = str(tmp_path / "dir a"), str(tmp_path / "dirb")
    one, _, two = _export(a, "p 1", ["A1", "B2"]), _export(a, "p2", ["A1"]), _export(b, "p+3", ["A1", "P24"])
    for paths, n in (([a, b], 5), ([b, a], 5), (f"{a}/*.txt", 3), ([f"file://{two}", one], 4), (a, 3), ([one, a], 3)):
        got = read_plates(spark, paths).collect()
        ords = [r.well_ord for r in got]
        assert len(got) == n and None not in ords and len(set(ords)) == n, paths
    first = read_plates(spark, [b, a]).filter("file_name = 'p+3'").collect()
    assert {r.plate_ord for r in first} == {0}


def test_same_name_in_two_folders_is_rejected(spark, tmp_path):
    _export(str(tmp_path / "x"), "p", ["A1"]), _export(str(tmp_path / "y"), "p", ["A1"])
    with pytest.raises(ValueError, match="two plates"):
        read_plates(spark, [str(tmp_path / "x"), str(tmp_path / "y")])


def test_rows_beyond_z_and_bad_positions(spark, tmp_path):
    pos = spark.createDataFrame([("A1",), ("Z48",), ("AA1",), ("AF48",), ("1A",)], "p string")
    got = {r.p: r.i for r in pos.select("p", well_index(pos.p, 48).alias("i")).collect()}
    assert got == {"A1": 0, "Z48": 25 * 48 + 47, "AA1": 26 * 48, "AF48": 32 * 48 - 1, "1A": None}
    _export(str(tmp_path), "p", ["A1", "1A"])
    with pytest.raises(Exception, match="no arrival ordinal"):
        read_plates(spark, str(tmp_path)).collect()


def test_sheets_in_listed_order(spark, tmp_path):
    small, large = str(tmp_path / "s.csv"), str(tmp_path / "l.csv")
    with open(small, "w") as fh:
        fh.write("file_name,gene\np,small\n")
    with open(large, "w") as fh:
        fh.write("file_name,gene\n" + "p,large\n" * 5000)
    for paths in ([small, large], [large, small]):
        first = read_sheet(spark, paths).orderBy("sheet_ord").first()
        assert first.gene == {small: "small", large: "large"}[paths[0]]


@pytest.mark.parametrize("kind", ["ttest", "wilcox"])
def test_guards(spark, kind):
    data = [("one", "g", "a", 1.0), ("one", "g", "a", 2.0), ("three", "g", "a", 1.0), ("three", "g", "b", 2.0), ("three", "g", "c", 3.0),
            ("none", "g", "a", None), ("none", "g", "b", None), ("single", "g", "a", 1.0),
            *[("two", "g", t, float(v)) for t in "ab" for v in range(3 if t == "a" else 4, 9)]]
    df = spark.createDataFrame(data, "zscoring_group string, Gene string, testing_group string, normalized_expression double")
    got = {r.zscoring_group: r for r in two_group_test(df, kind=kind, with_method=True).collect()}
    assert all(got[k].pvalue is None and got[k].test_status != "ok" for k in ("one", "three", "none", "single"))
    assert got["two"].test_status == "ok" and got["two"].method in ("welch", "normal", "exact")
    with pytest.raises(ValueError):
        two_group_test(df, kind="anova")


def _wells(fan_out):
    out = []
    for s in range(3):
        for rep in range(2):
            for g, gene in enumerate(("RHOA", "X", None)):
                for k in range(3):
                    n = len(out)
                    for t in (("t", "u") if fan_out and s == 0 else ("t",)):
                        out.append(("p", f"A{n}", s * 100 + rep * 20 + g * 4 + k, f"S{s}.{rep}", f"S{s}", "z", t, gene,
                                    "HK" if gene == "RHOA" else "Normal", 20.0 + g + 0.1 * k + 0.3 * s * g + 0.05 * rep))
    return out


def test_one_representative_with_metadata_fan_out(spark):
    a = analyse(spark.createDataFrame(_wells(True), WELLS), AnalysisConfig())
    report = a.report(ordered=False).filter("normalized_expression is not null").collect()
    groups = {(r.replicate_name, r.Gene) for r in report}
    assert len(report) == len(groups) == 18


@pytest.mark.parametrize("fan_out", [False, True])
def test_replay_without_overrides_equals_the_report(spark, tmp_path, fan_out):
    a = analyse(spark.createDataFrame(_wells(fan_out), WELLS), AnalysisConfig())
    cols = ["Pos", "replicate_name", "testing_group", "Gene", "normalized_expression", "normalized_expression_mean", "qc_flag"]
    want = rows(a.report(ordered=False), *cols)
    assert any(w[3] is None and w[5] is not None for w in want)  # NULL genes have a summary
    replayed, _ = recalculate(a.report(ordered=False))
    assert rows(replayed, *cols) == want
    a.report().write.parquet(str(tmp_path / "report"))
    replay_files(spark, str(tmp_path / "report"), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out/report")), *cols) == want


def test_label_clash_keeps_rows(spark):
    data = [("Normal", "z", "r1", "a_b", "c", "g", 1.0), ("Normal", "z", "r2", "a", "b_c", "g", 2.0), ("Normal", "z", "r3", "q", "c", None, 3.0)]
    df = spark.createDataFrame([(*d, 1.0, 1.0, "GOOD") for d in data], (
        "type_of_gene string, zscoring_group string, replicate_name string, sample_name string, testing_group string, Gene string, "
        "normalized_expression double, normalized_expression_mean double, normalized_expression_sd double, qc_flag string"))
    got = plot_points(df).collect()
    assert len(got) == 3 and {r.ordering for r in got} == {"a_b_c_g", "q_c_NA"}

"""Layout expansion edge cases, first-match lookup, metadata fan-out and the plate export reader."""

import os
import tempfile

from qplate.operators.layout import annotate_wells, expand_layout, first_match, unmatched_wells
from qplate.sources.plates import read_plates

SHEET = "file_name string, rows string, cols string, gene string, sheet_ord long"


def _cells(spark, rows, cols):
    sheet = spark.createDataFrame([("p1", rows, cols, "X", 0)], SHEET)
    return [r.Pos for r in expand_layout(sheet, "gene").orderBy("_ord").collect()]


def test_ranges_and_tokens(spark):
    assert _cells(spark, "A,B", "1-3,7") == ["A1", "A2", "A3", "A7", "B1", "B2", "B3", "B7"]
    assert _cells(spark, "A", "5-3") == ["A5", "A4", "A3"]          # descending range
    assert _cells(spark, "A,B,", "1") == ["A1", "B1"]               # one trailing empty piece ignored
    assert _cells(spark, "A", "1,,2") == ["A1", "ANA", "A2"]        # empty middle token is NA
    assert _cells(spark, "A", "x") == ["ANA"]                       # not a number
    assert _cells(spark, "A", " 3") == ["A3"]                       # integer parse trims
    assert _cells(spark, "", "1") == []


def test_first_match_wins_and_no_fanout(spark):
    sheet = spark.createDataFrame([("p1", "A", "1-2", "FIRST", 0), ("p1", "A", "2-3", "SECOND", 1)], SHEET)
    got = {r.Pos: r.Gene for r in first_match(expand_layout(sheet, "gene"), "gene", "Gene").collect()}
    assert got == {"A1": "FIRST", "A2": "FIRST", "A3": "SECOND"}


def test_annotation_fanout_and_unmatched(spark):
    wells = spark.createDataFrame([("p1", "A1", 0, 20.0), ("p1", "A2", 1, 21.0), ("p1", "A3", 2, 22.0)],
                                  "file_name string, Pos string, well_ord long, Cp double")
    genes = spark.createDataFrame([("p1", "A", "1-3", "RHOA", 0)], SHEET)
    samples = spark.createDataFrame([("p1", "A", "1", "S.1", 0), ("p1", "A", "2", "S.2", 1)],
                                    "file_name string, rows string, cols string, sample string, sheet_ord long")
    meta = spark.createDataFrame([("S.1", "S", "z", "t"), ("S.1", "S", "z2", "t")],
                                 "replicate_name string, sample_name string, zscoring_group string, testing_group string")
    ann = annotate_wells(wells, genes, samples, meta, ["RHOA"])
    assert ann.count() == 2                              # S.1 listed twice multiplies its well
    assert {r.type_of_gene for r in ann.collect()} == {"HK"}
    um = {(r.Pos, r.reason) for r in unmatched_wells(wells, genes, samples, meta).collect()}
    assert um == {("A2", "no_metadata"), ("A3", "no_replicate")}


def test_plate_export_round_trip(spark):
    d = tempfile.mkdtemp(prefix="qplate-io-")
    header = "Include\tColor\tPos\tName\tCp\tConcentration\tStandard\tStatus\r\n"
    for name, rows in [("p1", [("A1", "26,44"), ("A2", ""), ("A3", "35,00"), ("A10", "17,5")]),
                       ("p2", [("A1", "20,00")])]:
        with open(os.path.join(d, f"{name}.txt"), "w", newline="") as fh:
            fh.write(f"Experiment: {name}  Selected Filter: X\t\r\n")
            fh.write(header)
            for pos, cp in rows:
                fh.write(f'True\t255\t{pos}\t"Sample 1"\t{cp}\t\t0\t\r\n')
    paths = [os.path.join(d, "p2.txt"), os.path.join(d, "p1.txt")]
    df = read_plates(spark, paths)
    got = sorted((r.file_name, r.Pos, r.Cp, r.plate_ord, r.well_ord) for r in df.collect())
    assert got == [("p1", "A1", 26.44, 1, 4096), ("p1", "A10", 17.5, 1, 4105), ("p1", "A2", None, 1, 4097),
                   ("p1", "A3", 35.0, 1, 4098), ("p2", "A1", 20.0, 0, 0)]
    # directory read: plates ranked by name
    by_dir = read_plates(spark, d)
    assert sorted({(r.file_name, r.plate_ord) for r in by_dir.collect()}) == [("p1", 0), ("p2", 1)]


def test_sheet_reader_sink_and_meta_key(spark):
    import tempfile as _t

    from qplate.sources.plates import read_sheet, write_table
    d = _t.mkdtemp(prefix="qplate-sheet-")
    with open(os.path.join(d, "genes.csv"), "w") as fh:
        fh.write("file_name,rows,cols,gene\np1,A,1-2,RHOA\np1,A,2-3,TP53\n")
    sheet = read_sheet(spark, os.path.join(d, "genes.csv"),
                       schema="file_name string, rows string, cols string, gene string")
    assert [r.sheet_ord for r in sheet.orderBy("sheet_ord").collect()] == sorted(r.sheet_ord for r in sheet.collect())
    got = {r.Pos: r.Gene for r in first_match(expand_layout(sheet, "gene"), "gene", "Gene").collect()}
    assert got == {"A1": "RHOA", "A2": "RHOA", "A3": "TP53"}
    # metadata keyed "sample" (differing key names), then a partitioned Parquet sink
    wells = spark.createDataFrame([("p1", "A1", 0, 20.0)], "file_name string, Pos string, well_ord long, Cp double")
    samples = spark.createDataFrame([("p1", "A", "1", "S.1", 0)],
                                    "file_name string, rows string, cols string, sample string, sheet_ord long")
    meta = spark.createDataFrame([("S.1", "S", "z1", "t")], "sample string, sample_name string, zscoring_group string, testing_group string")
    ann = annotate_wells(wells, sheet, samples, meta, ["RHOA"], meta_key="sample")
    out = os.path.join(d, "out")
    write_table(ann, out, partition_by=["zscoring_group"])
    back = spark.read.parquet(out)
    assert [(r.replicate_name, r.zscoring_group, r.Gene) for r in back.collect()] == [("S.1", "z1", "RHOA")]
    assert os.path.isdir(os.path.join(out, "zscoring_group=z1"))


def test_file_workflow_end_to_end(spark):
    import tempfile as _t

    from qplate.config import AnalysisConfig
    from qplate.plans.pipeline import run_files
    d = _t.mkdtemp(prefix="qplate-flow-")
    header = "Include\tColor\tPos\tName\tCp\tConcentration\tStandard\tStatus\r\n"
    cps = {"A": [20.0, 20.2, 20.1], "B": [25.0, 25.1, 31.0]}     # row A: HK gene, row B: target gene
    for plate, shift in (("pl1", 0.0), ("pl2", 1.0)):
        with open(os.path.join(d, f"{plate}.txt"), "w", newline="") as fh:
            fh.write(f"Experiment: {plate}\r\n" + header)
            for row, vals in cps.items():
                for c, v in enumerate(vals, start=1):
                    fh.write(f"True\t255\t{row}{c}\tSample\t{str(v + shift).replace('.', ',')}\t\t0\t\r\n")
            fh.write(f"True\t255\tC1\tSample\t\t\t0\t\r\n")            # unassigned well
    genes = spark.createDataFrame([(p, "A", "1-3", "RHOA", 0) for p in ("pl1", "pl2")] +
                                  [(p, "B", "1-3", "TP53", 1) for p in ("pl1", "pl2")], SHEET)
    samples = spark.createDataFrame([("pl1", "A,B", "1-3", "S.1", 0), ("pl2", "A,B", "1-3", "S.2", 1)],
                                    "file_name string, rows string, cols string, sample string, sheet_ord long")
    meta = spark.createDataFrame([("S.1", "S", "z", "control"), ("S.2", "S", "z", "treated")],
                                 "replicate_name string, sample_name string, zscoring_group string, testing_group string")
    out = os.path.join(d, "out")
    paths = [os.path.join(d, "pl1.txt"), os.path.join(d, "pl2.txt")]
    run_files(spark, paths, genes, samples, meta, out, AnalysisConfig())
    rep = spark.read.parquet(os.path.join(out, "report"))
    assert rep.count() == 12
    kept = {(r.file_name, r.Pos): r.keep_this_value for r in rep.collect()}
    assert kept[("pl1", "B3")] == "NO keep" and kept[("pl1", "B1")] == "keep"
    norm = {r.replicate_name: r.normalized_expression for r in rep.filter("Gene = 'TP53'").collect()
            if r.normalized_expression is not None}
    # target mean 0.5^25.05 over HK mean 0.5^~20.1 (same shift on both plates -> equal ratios)
    assert abs(norm["S.1"] - norm["S.2"]) < 1e-12 * norm["S.1"]
    assert spark.read.parquet(os.path.join(out, "unmatched")).count() == 2
    assert spark.read.parquet(os.path.join(out, "statistics")).count() == 1
    assert os.path.isdir(os.path.join(out, "wells", "zscoring_group=z"))

"""Sheets are spread by their cells, and no join of the annotation broadcasts what a sheet's file size hides."""

from pyspark.sql import functions as F

from qplate.operators.layout import annotate_wells, attach_layouts, expand_layout, first_match, spread_sheet, unmatched_wells
from conftest import rows

SHEET = "file_name string, rows string, cols string, gene string, sheet_ord long"


def _sheet(spark, n=40):
    data = [(f"p{i % 7}", "A,B,C,", "1-12" if i % 2 else "24-13,x", f"g{i}", i) for i in range(n)]
    return spark.createDataFrame(data + [("p1", None, "1", "n", 900), ("p1", "A", None, "n", 901), ("p2", "", "1-3", "e", 902), (None, "A", "1", "f", 903)],
                                 SHEET).coalesce(1)


def _inputs(spark):
    wells = spark.createDataFrame([(f"p{p}", f"{r}{c}", p * 384 + c) for p in range(8) for r in "AZ" for c in range(1, 25)],
                                  "file_name string, Pos string, well_ord long")
    sheet = _sheet(spark)
    samples = sheet.withColumnRenamed("gene", "sample").filter("sheet_ord % 3 < 2")
    meta = spark.createDataFrame([(f"g{i}", f"s{i}") for i in range(0, 40, 2)] + [("g0", "again")], "replicate_name string, sample_name string")
    return wells, sheet, samples, meta


def test_sheet_is_spread_by_its_cells(spark):
    sheet = _sheet(spark)
    spread = spread_sheet(sheet, cells_per_task=100)
    cells = expand_layout(sheet, "gene").count()
    assert spread.rdd.getNumPartitions() == -(-cells // 100)
    assert spread_sheet(sheet).rdd.getNumPartitions() == 1 and spread_sheet(sheet.limit(0)).count() == 0
    look = lambda s: rows(first_match(expand_layout(s, "gene"), "gene", "Gene"), "file_name", "Pos", "Gene")
    assert look(spread) == look(sheet)


def test_annotation_has_no_broadcast(spark):
    wells, genes, samples, meta = _inputs(spark)
    for df in (annotate_wells(wells, genes, samples, meta, ["g1"]), unmatched_wells(wells, genes, samples, meta)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_annotation_against_a_plain_model(spark):
    wells, genes, samples, meta = _inputs(spark)
    first = {}
    for name, sheet in (("gene", genes), ("sample", samples)):
        for r in sheet.orderBy(F.desc("sheet_ord")).collect():  # the earliest row is written last
            if r.rows and r.cols:
                numbers = range(1, 13) if r.cols == "1-12" else range(13, 25) if r.cols == "24-13,x" else [1]
                for row in r.rows.strip(",").split(","):
                    for c in numbers:
                        first[name, r.file_name, f"{row}{c}"] = r[name]
    got = rows(attach_layouts(wells, genes, samples), "file_name", "Pos", "Gene", "replicate_name")
    assert got == sorted(((w.file_name, w.Pos, first.get(("gene", w.file_name, w.Pos)), first.get(("sample", w.file_name, w.Pos)))
                          for w in wells.collect()), key=repr)
    n = {k: sum(1 for m in meta.collect() if m.replicate_name == k) for k in set(first.values())}
    assert annotate_wells(wells, genes, samples, meta, ["g1"]).count() == sum(n[r[3]] for r in got if r[3])


def test_small_sheet_files_are_not_broadcast(spark, tmp_path):
    """A sheet's file says nothing of its cells: below the threshold as a file, its lookup may be any size."""
    def stored(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    wells, genes, samples, meta = (stored(df, f"t{i}") for i, df in enumerate(_inputs(spark)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        for df in (annotate_wells(wells, genes, samples, meta, ["g1"]), unmatched_wells(wells, genes, samples, meta)):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

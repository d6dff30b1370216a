"""Change propagation against the full replay; sorted and split sinks; wide rows, bitmaps, levels and the chunk complement."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_edge_inputs import WELLS

from qplate import AnalysisConfig
from qplate.operators import comparisons
from qplate.operators.comparisons import bitmap_totals, comparison_strings, tolerance_bitmaps
from qplate.operators.outliers import complements, leave_one_out
from qplate.operators.plotdata import category_levels, column_dictionary, duplicate_cells, wide_rows, with_category
from qplate.plans.pipeline import REPORT_KEYS, analyse, recalculate, report_order
from qplate.plans.replay import OUTPUT, merge_changes, replay_changes
from qplate.sources.sinks import read_sorted, write_sorted, write_split


def _wells(seed, n_samples=9, fan_out=True):
    r, out = random.Random(seed), []
    for s in range(n_samples):
        for rep in range(r.randint(1, 4)):
            for gene in ("RHOA", "X", "Y", None):
                for _ in range(r.randint(1, 4)):
                    n = len(out)
                    cp = round(20 + r.random() * 4 + (12 if r.random() < 0.05 else 0), 2)
                    for t in (("t", "u") if fan_out and s == 0 else (("t", "u")[s % 2],)):
                        out.append((f"p{n % 3}", f"A{n}", n, f"S{s}.{rep}", f"S{s}", f"z{s % 3}", t, gene, "HK" if gene == "RHOA" else "Normal", cp))
    return out


def _near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def _same(got, want, columns):
    key = lambda r: tuple(repr(x) for x in r[:9])
    got, want = (sorted((tuple(r) for r in df.select(*columns).collect()), key=key) for df in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(map(_near, g, w)), (g, w)


@pytest.mark.parametrize("seed", [0, 3])
def test_changes_equal_the_full_replay(spark, seed):
    r = random.Random(seed)
    cfg = AnalysisConfig(test_type="ttest" if seed % 2 else "wilcox")
    a = analyse(spark.createDataFrame(_wells(seed), WELLS), cfg)
    report = a.report()
    report = spark.createDataFrame(report.collect(), report.schema)  # one fixed report for both
    rows = report.collect()
    edits = [(w.file_name, w.Pos, r.choice([None, "keep", "NO keep"]), r.choice([None, "GOOD", "BAD"]) if w.qc_flag else None) for w in r.sample(rows, 5)]
    edits = list({e[:2]: e for e in edits}.values()) + [("none", "A1", "keep", None)]
    overrides = spark.createDataFrame(edits, "file_name string, Pos string, keep_this_value string, qc_flag string")
    full, full_stats = recalculate(report, cfg, overrides)
    before, stats = recalculate(report, cfg)
    changes = replay_changes(report, overrides, cfg)
    got, got_stats = merge_changes(report, stats, changes)
    columns = [*[c for c in OUTPUT if c not in ("elevated_value_mean", "normalized_expression", "log2_expression_value")], "elevated_value_mean",
               "normalized_expression", "log2_expression_value"]
    _same(got, full, columns)
    _same(got_stats, full_stats, full_stats.columns)
    assert changes.rows.count() < len(rows)


def test_no_change_replays_nothing(spark):
    report = analyse(spark.createDataFrame(_wells(9), WELLS), AnalysisConfig()).report()
    report = spark.createDataFrame(report.collect(), report.schema)
    same = report.limit(3).select("file_name", "Pos", "keep_this_value", F.lit(None).cast("string").alias("qc_flag"))
    changes = replay_changes(report, same)
    assert changes.rows.count() == 0 and changes.tests.count() == 0 and changes.statistics.count() == 0


def test_touched_names_reach_the_files(spark, tmp_path):
    report = analyse(spark.createDataFrame(_wells(1), WELLS), AnalysisConfig()).report()
    write_sorted(report, str(tmp_path / "r"), report_order(), REPORT_KEYS, rows_per_file=20)
    stored = spark.read.parquet(str(tmp_path / "r"))
    w = stored.filter("keep_this_value = 'keep'").first()
    from qplate.plans.replay import _named, touched_replicates
    o = spark.createDataFrame([(w.file_name, w.Pos, "NO keep", None)], "file_name string, Pos string, keep_this_value string, qc_flag string")
    plan = _named(stored, touched_replicates(stored, o))._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(replicate_name,{w.replicate_name})" in plan or f"In(replicate_name, [{w.replicate_name}])" in plan


def test_sorted_files_follow_each_other(spark, tmp_path):
    rows = [(random.Random(i).choice([None, "a", "b", "ä"]), i % 50) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, n long").repartition(7)
    order = [F.col("k").asc_nulls_last(), F.col("n").desc()]
    manifest = write_sorted(df, str(tmp_path / "t"), order, ["k", "n"], rows_per_file=60).orderBy("file_no").collect()
    assert sum(m.n_rows for m in manifest) == 700 and max(m.n_rows for m in manifest) <= 60
    assert [m.first_row for m in manifest] == [sum(x.n_rows for x in manifest[:i]) for i in range(len(manifest))]
    back = read_sorted(spark, str(tmp_path / "t")).orderBy("row_no").collect()
    assert [r.row_no for r in back] == list(range(700))
    assert [(r.k, r.n) for r in back] == sorted(rows, key=lambda x: (x[0] is None, (x[0] or "").encode(), -x[1]))
    first = manifest[1].first_row
    assert tuple(manifest[1].first_key) == (back[first].k, back[first].n) and tuple(manifest[0].last_key) == (back[first - 1].k, back[first - 1].n)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 700  # the manifest is hidden
    assert write_sorted(df.limit(0), str(tmp_path / "e"), order, ["k", "n"]).count() <= 1


def test_hot_group_is_split(spark, tmp_path):
    rows = [("hot" if i % 3 else None if i % 2 else "x", i) for i in range(900)]
    write_split(spark.createDataFrame(rows, "g string, i long"), str(tmp_path / "s"), ["g"], rows_per_file=50)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r.g, r.i) for r in back.filter("g is not null").collect()) == sorted(r for r in rows if r[0]) and back.count() == 900
    sizes = back.groupBy("g", F.col("_metadata.file_path").alias("f")).count().collect()
    assert max(s["count"] for s in sizes) <= 50 and sum(s.g == "hot" for s in sizes) >= 12


# ---- bitmaps

def _plain_strings(rows, tol):
    """rows: (group, well_ord, cp) in arrival order within groups."""
    out = {}
    for g in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        for _, o, x in group:
            first = next((i for i, r in enumerate(group) if x is not None and r[2] == x), None)
            out[g, o] = ",".join("good" if x is not None and r[2] is not None and abs(r[2] - x) <= tol else "bad" for i, r in enumerate(group) if i != first)
    return out


@pytest.mark.parametrize("arrivals,values", [(1024, 256), (3, 2)])
def test_bitmaps_render_the_comparison_column(spark, monkeypatch, arrivals, values):
    monkeypatch.setattr(comparisons, "ARRIVALS", arrivals)
    monkeypatch.setattr(comparisons, "VALUES", values)
    r = random.Random(arrivals)
    rows = [(g, i * 7 % 101, r.choice([20.0, 20.5, 20.25, 21.0, 22.0, round(20 + r.random(), 2), None])) for g in ("a", None, "c") for i in range(25)]
    rows += [("one", 5, 20.0), ("same", 1, 30.0), ("same", 2, 30.0), ("s5", 1, 20.0), ("s5", 2, 25.0), ("s5", 3, 20.0)]
    df = spark.createDataFrame([("r", g, o, x) for g, o, x in rows], "replicate_name string, Gene string, well_ord long, Cp double")
    got = {(x.Gene, x.well_ord): x.comparison_results for x in comparison_strings(df, 0.5).collect()}
    assert got == _plain_strings(rows, 0.5)
    assert (got["s5", 1], got["s5", 2], got["s5", 3]) == ("bad,good", "bad,bad", "bad,good") and got["one", 5] == ""
    for t in bitmap_totals(tolerance_bitmaps(df, 0.5)).collect():
        group = [x for g, _, x in rows if g == t.Gene]
        assert t.n_wells == len(group) and t.n_good == sum(x is not None and t.x is not None and abs(x - t.x) <= 0.5 for x in group)


def test_bitmap_rows_grow_with_distinct_values(spark):
    df = spark.range(6000).select(F.lit("r").alias("replicate_name"), F.lit("g").alias("Gene"), F.col("id").alias("well_ord"),
                                  (F.lit(20.0) + (F.col("id") * 37 % 11) / 10).alias("Cp"))
    rows = tolerance_bitmaps(df, 0.3).select("chunk", "n", F.size("changes").alias("c")).collect()
    assert len(rows) == 11 * 6 and max(r.n for r in rows) == 1024
    plan = tolerance_bitmaps(df, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# ---- wide rows

def test_wide_rows_over_data_dependent_columns(spark):
    cells = {("z1", "g1", "s1"): 1.0, ("z1", "g1", "s4"): 4.0, ("z1", "g2", "s2"): 2.0, ("z1", None, "s3"): None, ("z2", "g1", "s9"): 9.0, ("z2", "g1", None): 0.5}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "zscoring_group string, Gene string, sample_name string, v double")
    names = {(r.zscoring_group, r.sample_name): r.position for r in column_dictionary(df, ["zscoring_group"], "sample_name").collect()}
    assert names == {("z1", "s1"): 0, ("z1", "s2"): 1, ("z1", "s3"): 2, ("z1", "s4"): 3, ("z2", "s9"): 0, ("z2", None): 1}
    rows = {(r.zscoring_group, r.Gene): (r.block, r.first, r.cells) for r in wide_rows(df, ["Gene"], "sample_name", "v").collect()}
    assert rows == {("z1", "g1"): (0, 0, [1.0, None, None, 4.0]), ("z1", "g2"): (0, 0, [None, 2.0, None, None]),
                    ("z1", None): (0, 0, [None] * 4), ("z2", "g1"): (0, 0, [9.0, 0.5])}
    parts = sorted((r.zscoring_group, str(r.Gene), r.block, r.first, r.cells) for r in wide_rows(df, ["Gene"], "sample_name", "v", block=3).collect())
    assert parts == [("z1", "None", 0, 0, [None] * 3), ("z1", "g1", 0, 0, [1.0, None, None]), ("z1", "g1", 1, 3, [4.0]),
                     ("z1", "g2", 0, 0, [None, 2.0, None]), ("z2", "g1", 0, 0, [9.0, 0.5])]
    twice = df.unionByName(df.filter("sample_name = 's2'"))
    assert duplicate_cells(twice, ["zscoring_group", "Gene"], "sample_name").count() == 1
    with pytest.raises(Exception, match="more than one value in cell"):
        wide_rows(twice, ["Gene"], "sample_name", "v").collect()
    assert wide_rows(df.limit(0), ["Gene"], "sample_name", "v").count() == 0


# ---- explicit levels

def test_levels_sort_join_and_keep_unknown_values(spark):
    df = spark.createDataFrame([("b",), ("x",), (None,), ("a",), ("c",)], "v string")
    levels = category_levels(["c", "a", "b", "never"], spark)
    got = [(r.v, r.v_level, r.v_level_rank) for r in with_category(df, "v", levels).orderBy(F.col("v_level_rank").asc_nulls_last(), "v").collect()]
    assert got == [("c", "c", 1), ("a", "a", 2), ("b", "b", 3), (None, None, None), ("x", None, None)]
    table = spark.createDataFrame([("a", 20), ("c", 5), ("b", 20), (None, 1)], "level string, rank int")
    assert sorted(map(tuple, category_levels(table).collect())) == [("a", 2), ("b", 3), ("c", 1)]
    assert with_category(df, "v", category_levels([], spark)).filter("v_level is not null").count() == 0
    with pytest.raises(ValueError, match="repeated level 'a'"):
        category_levels(["a", "b", "a"], spark)
    with pytest.raises(Exception, match="repeated level a"):
        category_levels(table.unionByName(table.filter("level = 'a'"))).collect()


# ---- chunk complement

def test_complement_of_each_chunk(spark, monkeypatch):
    from qplate.operators import outliers
    monkeypatch.setattr(outliers, "BLOCK_CHUNKS", 4)
    r = random.Random(2)
    data = {(k, c): [r.choice([1e6, -3.0, r.random()]) for _ in range(r.choice([0, 1, 1, 2, 5]))] for k in ("a", None) for c in range(30)}
    data["one", 3] = [1.0, 2.0]

    def summary(v):
        m = math.fsum(v) / len(v) if v else None
        return len(v), m, math.fsum((x - m) ** 2 for x in v) if v else None

    df = spark.createDataFrame([(k, c, *summary(v)) for (k, c), v in data.items()], "k string, c long, n long, mean double, m2 double")
    got = {(x.k, x.c): x for x in complements(df, ["k"], "c").collect()}
    assert len(got) == len(data)
    for k, c in data:
        n, mean, m2 = summary([x for (k2, c2), v in data.items() if k2 == k and c2 != c for x in v])
        x = got[k, c]
        assert x.o_n == n and (n == 0 or (math.isclose(x.o_mean, mean, rel_tol=1e-12) and math.isclose(x.o_m2, m2, rel_tol=1e-9, abs_tol=1e-9)))


def test_leave_one_out_gathers_no_lists(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(40)], "k string, i long, v double")
    out = leave_one_out(df, ["k"], "v", ["i"], chunk_rows=5)
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        others = [float(i) for i in range(40) if i != r.i]
        assert r._o_n == 39 and r._o_mean == pytest.approx(sum(others) / 39)

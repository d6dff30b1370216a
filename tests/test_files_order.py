"""Files named in any way are numbered, read once and in order, whatever Spark packs together; unreadable lines are told apart."""

import os

import pytest
from test_edge_inputs import _export

from qplate.sources.exports import write_exports
from qplate.sources.files import Entries, numbered_files, pattern_regex
from qplate.sources.plates import read_plates, read_sheet, rejected_lines
from qplate.streaming import ingest_plates


def _plate(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{name}.txt"), "w", newline="") as fh:
        fh.write("Experiment: any text\r\nInclude\tColor\tPos\tName\tCp\tConcentration\tStandard\tStatus\r\n")
        fh.writelines(f"{x}\r\n" for x in lines)
    return os.path.join(folder, f"{name}.txt")


def test_files_are_numbered_by_entry_then_path(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for folder, names in ((a, "zy"), (b, "xw"), (f"{a}/deep", "v")):
        for n in names:
            _export(folder, n, ["A1"])
    names = lambda paths: [r.name for r in numbered_files(spark, paths).orderBy("_row").collect()]
    assert names([b, a]) == ["w", "x", "y", "z"] and names([a, b]) == ["y", "z", "w", "x"]
    assert names([f"{b}/x.txt", f"{a}/*.txt", b]) == ["x", "y", "z", "w"]
    assert names([f"{a}/[z]*.txt", f"{a}/{{y,z}}.txt", f"{a}//deep/"]) == ["z", "y", "v"]
    assert names([f"{a}/deep", a]) == ["v", "y", "z"]  # a folder does not hold those below it
    assert names([f"file://{a}/z.txt", f"{a}/../a/z.txt", a])[0] == "z"
    rows = numbered_files(spark, [b, a]).collect()
    assert sorted(r._row for r in rows) == [0, 1, 2, 3]
    got = read_plates(spark, [f"{a}/z*", a, f"{a}/*.txt", f"{b}/x.txt"]).collect()
    assert sorted((r.file_name, r.plate_ord) for r in got) == [("x", 2), ("y", 1), ("z", 0)]  # each once


def test_no_list_of_files_passes_the_driver(spark, tmp_path, monkeypatch):
    _export(str(tmp_path), "p", ["A1"])
    from pyspark.sql import DataFrame
    monkeypatch.setattr(DataFrame, "inputFiles", lambda self: pytest.fail("listed in the driver"))
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: pytest.fail("table made in the driver"))
    assert read_plates(spark, str(tmp_path)).count() == 1


def test_patterns_are_read_as_regular_expressions():
    import re
    for pattern, hits, misses in (("/a/*.txt", ["/a/x.txt", "/a/.txt"], ["/a/b/x.txt", "/a/xtxt"]), ("/a/{b,c}?", ["/a/b1", "/a/cc"], ["/a/b", "/a/d1"]),
                                  ("/a/[!b-c]x", ["/a/ax"], ["/a/bx", "/a//x"]), ("/a+(1)/*", ["/a+(1)/y"], ["/aa1/y"])):
        r = re.compile(pattern_regex(pattern))
        assert all(r.match(h) for h in hits) and not any(r.match(m) for m in misses), pattern


def test_partition_folders_belong_to_their_entry(spark, tmp_path):
    entries = Entries(spark, [str(tmp_path)])
    paths = [f"file:{tmp_path}/p.txt", f"file:{tmp_path}/k=1/p.txt", f"file:{tmp_path}/k=1/j=2/p.txt", f"file:{tmp_path}/deep/p.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(entries.holds(df.p, entries.given)).collect()] == [True, True, True, False]


def test_unreadable_lines_fail_or_are_listed(spark, tmp_path):
    ok = 'True\t255\tA1\t"Sample 1"\t26,44\t\t0\t'
    lines = [ok, ok.replace("A1", "A2").replace("26,44", "n/a"), ok.replace("A1", "A3").replace("26,44", "26.441,10"),
             ok.replace("A1", "A4").replace("26,44", ""), ok.replace("A1", "A5").replace("26,44", "27.5"), "True\t255\tA6\t30,0",
             ok.replace("A1", "6A"), "Tru\t255\tA7\tx\t20,0\t\t0\t", ok.replace("A1", "A8").replace("26,44", "-1,5"), ok.replace("A1", "A9").replace("26,44", "1e3")]
    path = _plate(str(tmp_path), "p", lines)
    with pytest.raises(Exception, match="unreadable"):
        read_plates(spark, path).collect()
    got = sorted((r.Pos, r.Cp) for r in read_plates(spark, path, on_bad_line="drop").collect())
    assert got == [("A1", 26.44), ("A4", None), ("A5", 27.5), ("A8", -1.5)]
    told = sorted((r.line, r.reason) for r in rejected_lines(spark, path).collect())
    assert told == [(4, "Cp"), (5, "Cp"), (8, "fields"), (9, "position"), (10, "kind"), (12, "Cp")]
    with pytest.raises(ValueError):
        read_plates(spark, path, on_bad_line="skip")


def test_written_exports_come_back(spark, tmp_path):
    rows = [(f"plate {k % 3}+", f"{'ABCDEFGHIJKLMNOP'[i // 24]}{i % 24 + 1}", k * 1000 + i, None if i % 7 == 0 else 20 + i / 3) for k in range(3) for i in range(50)]
    wells = spark.createDataFrame(rows, "file_name string, Pos string, well_ord long, Cp double").repartition(5)
    for _ in range(2):  # a second run replaces the plates
        assert sorted(map(tuple, write_exports(wells, str(tmp_path / "out")).collect())) == [(f"plate {k}+", 50) for k in range(3)]
    back = read_plates(spark, str(tmp_path / "out")).collect()
    assert sorted((r.file_name, r.Pos, r.Cp) for r in back if r.Cp) == sorted((f, p, c) for f, p, _, c in rows if c)
    assert len(back) == 150 and len({r.well_ord for r in back}) == 150
    assert sorted(os.listdir(tmp_path / "out")) == [f"plate {k}+.txt" for k in range(3)]


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_sheets_of_folders_and_patterns_keep_file_order(spark, tmp_path, small_splits):
    """Spark packs large files first and cuts them; the order is that of names and rows all the same."""
    sizes = {"a": 2, "b": 900, "c": 40, "d": 1}
    for n, k in sizes.items():
        with open(tmp_path / f"{n}.csv", "w") as fh:
            fh.write("file_name,gene\n" + "".join(f"p,{n}{i}\n" for i in range(k)))
    want = [f"{n}{i}" for n, k in sizes.items() for i in range(k)]
    for path in (str(tmp_path), f"{tmp_path}/*.csv", [str(tmp_path / f"{n}.csv") for n in sizes], [f"{tmp_path}/[ab].csv", str(tmp_path)]):
        got = read_sheet(spark, path).orderBy("sheet_ord").collect()
        assert [r.gene for r in got] == want and [r.sheet_ord for r in got] == list(range(len(want))), path
    got = read_sheet(spark, [f"{tmp_path}/c.csv", str(tmp_path)]).orderBy("sheet_ord").collect()
    assert [r.gene for r in got] == want[902:942] + want[:902] + want[942:]


def test_sheets_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("file_name,gene\np,x\n")
    (tmp_path / "b.csv").write_text("gene,note,file_name\ny,n,q\n")
    rows = read_sheet(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")]).orderBy("sheet_ord").collect()
    assert [(r.file_name, r.gene, r.note) for r in rows] == [("q", "y", "n"), ("p", "x", None)]
    with pytest.raises(Exception, match="(?i)header"):
        read_sheet(spark, str(tmp_path)).collect()  # one folder, two headers


def test_stream_reads_as_the_batch_reader(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    _export(f"{src}", "p 1+x", ["A1", "B2"])
    ingest_plates(spark, src, out, ck).awaitTermination()
    _export(f"{src}", "p2", ["A1"])
    ingest_plates(spark, src, out, ck).awaitTermination()
    got = sorted((r.file_name, r.Pos, r.Cp) for r in spark.read.parquet(out).collect())
    assert got == [(r.file_name, r.Pos, r.Cp) for r in sorted(read_plates(spark, src).collect(), key=lambda r: (r.file_name, r.Pos))]
    bad = _plate(src, "p3", ['True\t255\tA1\tS\tn/a\t\t0\t'])
    with pytest.raises(Exception, match="unreadable"):
        ingest_plates(spark, src, out, ck).awaitTermination()
    assert os.path.exists(bad)


def test_stream_rejects_twins(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    _export(f"{src}/x", "p", ["A1"])
    ingest_plates(spark, f"{src}/*", out, ck).awaitTermination()
    _export(f"{src}/y", "p", ["A1"])
    with pytest.raises(Exception, match="two plates"):
        ingest_plates(spark, f"{src}/*", out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 1

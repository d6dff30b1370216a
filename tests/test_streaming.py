import os
import tempfile

from qplate.streaming import ingest_plates


def _export(path, name, rows):
    with open(os.path.join(path, f"{name}.txt"), "w", newline="") as fh:
        fh.write(f"Experiment: {name}  Selected Filter: X\r\n")
        fh.write("Include\tColor\tPos\tName\tCp\tConcentration\tStandard\tStatus\r\n")
        for pos, cp in rows:
            fh.write(f"True\t255\t{pos}\tSample 1\t{cp}\t\t0\t\r\n")


def test_incremental_ingest_is_exactly_once(spark):
    base = tempfile.mkdtemp(prefix="qplate-stream-")
    src, out, ck = (os.path.join(base, d) for d in ("in", "out", "ck"))
    os.makedirs(src)
    _export(src, "p1", [("A1", "26,44"), ("A2", "")])
    ingest_plates(spark, src, out, ck).awaitTermination()
    _export(src, "p2", [("B3", "30,10")])
    ingest_plates(spark, src, out, ck).awaitTermination()
    ingest_plates(spark, src, out, ck).awaitTermination()        # nothing new: no duplicates
    got = sorted((r.file_name, r.Pos, r.Cp) for r in spark.read.parquet(out).collect())
    assert got == [("p1", "A1", 26.44), ("p1", "A2", None), ("p2", "B3", 30.1)]
    ords = {r.Pos: r.well_ord for r in spark.read.parquet(out).collect()}
    assert ords["A1"] < ords["A2"] < ords["B3"]

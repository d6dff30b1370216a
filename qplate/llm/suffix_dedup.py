"""Exact removal of repeated byte strings by nested fingerprints at positions that the text chooses.

This takes the place of prefix doubling: no rank is made from earlier ranks and nothing is sorted.

A byte is removed when a string of ``length`` bytes that covers it starts anywhere else too.  A full suffix
array would rank every byte position; here equal strings are compared at positions that they choose
themselves (the gram of least hash inside the string, see :func:`spans.anchors`), about one
position in ``length / 2.3`` bytes.  A position stands for the strings that chose it.

Each round names a longer span around a position by a fingerprint of its bytes, taken from the text; equal spans have
equal names.  It groups equal names in Spark, drops positions that have become unique, and goes on with spans that close
in on ``length``:

* round 0: the gram; positions with a unique gram are done;
* round i: for a run of ``STEPS[i]`` strings of a position, the ``core`` all of them share (it grows
  towards ``length``) and the ``union`` of them.  A unique core ends the run: no string of it is repeated.  A
  repeated union ends it too: all of them are.  Other runs are split for the next round;
* last round: runs of one string, core = union = the string itself, past the threshold.

Runs that are already known to repeat stay as one witness per union where others of their core go on.

Only equality is needed, so names are 64-bit fingerprints (unions: 128 bits) in place of ordinals.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qplate.llm import spans
from qplate.llm.common import pin, shared_folder

GRAM = 32
STEPS = (64, 8, 1)
RUN = "rid long, run long"
RANKS = "rid long, run long, core long, u1 long, u2 long"


def _pack(pos, lo, hi):
    """A position and a range of distances (below 2^12) as one long."""
    return (pos << 24) | (lo << 12) | hi


def _unpack(run):
    return run >> 24, (run >> 12) & 0xFFF, run & 0xFFF


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed [start, end) pairs) and kept bytes' text.

    Texts are UTF-8 bytes, NULL is empty; matches never cross documents; repeated rows are documents of
    their own, so their texts of ``length`` bytes or more go whole.  NULL ids stay.  An empty table gives no rows.
    The texts are written once, bucketed by a row number, so that no round shuffles them again.
    """
    if not GRAM < length < 2048:
        raise ValueError(f"length must be above {GRAM} and below 2048")
    spark = docs.sparkSession
    src = _bucketed(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data")))
    steps = (*[s for s in STEPS if s < length - GRAM + 1 or s == 1],)

    def choose(batches):
        for b in batches:
            rids, runs, grams = [], [], []
            for rid, data in zip(b.column(0).to_pylist(), b.column(1)):
                pos, lo, hi, name = spans.anchors(np.frombuffer(data.as_buffer(), np.uint8), length, GRAM)
                rids.append(np.full(len(pos), rid))
                runs.append(_pack(pos, lo, hi))
                grams.append(name.view(np.int64))
            yield _batch(["rid", "run", "gram"], rids, runs, grams)

    grams = pin(src.select("rid", "data").filter(F.length("data") >= length)
                .mapInArrow(choose, RUN + ", gram long"), "grams")
    # pinned, so that the join deals both sides itself and a hot gram can be split
    repeated = pin(grams.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "repeated")
    live = grams.join(repeated, "gram", "left_semi").select("rid", "run")
    covered = []
    for step in steps:
        per_doc = live.groupBy("rid").agg(F.collect_list("run").alias("runs"))
        ranks = pin(src.join(per_doc, "rid").select("rid", "data", "runs").mapInArrow(_ranker(step, length), RANKS), "ranks")
        unions = pin(ranks.groupBy("core", "u1", "u2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "run")).alias("r")),
                     "unions")
        covered.append(ranks.join(unions.filter("n > 1").select("core", "u1", "u2"), ["core", "u1", "u2"], "left_semi")
                       .select("rid", "run", F.lit(step).alias("step")))
        split = unions.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1").select("core")
        live = unions.join(split, "core", "left_semi").select("r.rid", "r.run")
    every = covered[0]
    for c in covered[1:]:
        every = every.unionByName(c)
    marks = every.groupBy("rid").agg(F.collect_list(F.struct("run", "step")).alias("marks"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
    return src.join(marks, "rid", "left").select("doc_id", "data", F.col("marks.run").alias("runs"),
                                                 F.col("marks.step").alias("steps")).mapInArrow(_cutter(length), out)


def _bucketed(rows: DataFrame) -> DataFrame:
    """``rows`` with a row number, written once in buckets of it; joins on it shuffle the other side only."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"qplate_texts_{uuid.uuid4().hex}"
    (rows.withColumn("rid", F.monotonically_increasing_id()).repartition(n, "rid").write.bucketBy(n, "rid")
     .option("path", shared_folder(spark, "texts")).option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


def _ranker(step: int, length: int):
    def rank(batches):
        for b in batches:
            rids, runs, cores, u1, u2 = [], [], [], [], []
            for rid, data, live in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                buf = np.frombuffer(data.as_buffer(), np.uint8)
                pos, lo, hi = _unpack(live.values.to_numpy())
                first, many = lo // step, hi // step - lo // step + 1
                row = np.repeat(np.arange(len(pos)), many)
                d = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                pos, lo, hi = pos[row], np.maximum(lo[row], d * step), np.minimum(hi[row], (d + 1) * step - 1)
                near, far = d * step, (d + 1) * step - 1
                salt = spans.mix((d + 4096 * step).astype(np.uint64))
                run = _pack(pos, lo, hi)
                core = spans.names(buf, pos - near, pos - far + length) ^ salt
                s, e = pos - far, pos - near + length
                inside = (s >= 0) & (e <= len(buf))
                a, z = np.where(inside, s, 0), np.where(inside, e, 0)
                own = spans.mix(run.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(rid))
                rids.append(np.full(len(run), rid))
                runs.append(run)
                cores.append(core.view(np.int64))
                # a run at the edge of its document has no union: a name of its own keeps it apart
                u1.append(np.where(inside, spans.names(buf, a, z), own).view(np.int64))
                u2.append(np.where(inside, spans.names(buf, a, z, 1), np.uint64(step)).view(np.int64))
            yield _batch(["rid", "run", "core", "u1", "u2"], rids, runs, cores, u1, u2)
    return rank


def _cutter(length: int):
    def cut(batches):
        for b in batches:
            rows = []
            for doc_id, data, runs, steps in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                buf = data.as_buffer().to_pybytes()
                keep, removed, found = hashlib.sha256(), 0, []
                at = 0
                if runs.is_valid:
                    found = _merged(*_covered(runs.values.to_numpy(), steps.values.to_numpy().astype(np.int64), length))
                for s, e in found:
                    keep.update(buf[at:s])
                    removed += e - s
                    at = e
                keep.update(buf[at:])
                rows.append((doc_id, len(buf), removed, len(found), keep.hexdigest(), [x for p in found for x in p]))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4]), pa.array(cols[5], pa.list_(pa.int64()))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    return cut


def _covered(runs, steps, length):
    pos, lo, _ = _unpack(runs)
    near = lo // steps * steps
    return pos - near - steps + 1, pos - near + length


def _merged(starts, ends) -> list[tuple[int, int]]:
    """Sorted maximal runs of overlapping or touching [start, end)."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return list(zip(s[new].tolist(), e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])].tolist()))


def _batch(cols, *parts):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(p) if p else np.zeros(0), pa.int64()) for p in parts], names=cols)

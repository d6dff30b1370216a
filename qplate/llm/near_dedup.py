"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct word shingles.  Each of ``BUCKETS`` buckets (the top bits of a shingle's hash)
keeps the least hash in compressed form, one byte: the number of leading zeros and the ``MANTISSA`` bits behind the first
one.  For the bands, empty buckets borrow the register of the full bucket that they prefer in a fixed random
order, so that short documents agree in a register as often as their sets do.  Bands of ``ROWS`` registers are compared by equality.  A
shared band makes a candidate; its Jaccard similarity is estimated from the first ``ESTIMATE`` registers, corrected for
the chance agreement of compressed registers, and unless the estimate is far below the threshold the link is confirmed on
the full sets.

Documents with equal sets are one vertex, so copies make no pairs.  Inside a band a group is never
expanded into its pairs: each round links the members that are in other components to one representative, which
differs by round.  Members that are still apart after the last round are compared through the rarest shingles of their sets (an
exact condition of the similarity), so no candidate across components is left untested.

At a similarity of 0.75 a pair shares none of the 73 bands with probability (1 - 0.75^7)^73, about 3e-5; at 0.8 it is 4e-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qplate.llm.common import NO_ID, pin, row_key, spare
from qplate.llm.components import components
from qplate.llm.spans import mix, prefixes

BUCKET_BITS, ROWS, MANTISSA = 9, 7, 4
BUCKETS = 1 << BUCKET_BITS
ZEROS = (1 << (8 - MANTISSA)) - 2  # greatest number of leading zeros that a register tells apart
ESTIMATE = 128
STAR_ROUNDS = 4
_PREFER = (mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(BUCKETS, BUCKETS)


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles (the whole sequence if shorter, none without words)."""
    words = text.lower().split()  # bytes: ASCII white space and A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    buf = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    total, down = prefixes(buf)
    word = mix((total[ends] - total[ends - lengths]) * down[ends - lengths] + lengths.astype(np.uint64))
    n = min(size, len(words))
    runs = len(words) - n + 1
    out = np.full(runs, np.uint64(n), dtype=np.uint64)
    for j in range(n):  # an odd factor for each place
        out += word[j:j + runs] * np.uint64(0x9E3779B97F4A7C15 ^ (j << 8))
    return np.unique(mix(out))


def registers(hashes: np.ndarray) -> np.ndarray:
    """One byte a bucket: 1 + leading zeros above MANTISSA bits; 0 for an empty bucket."""
    regs = np.zeros(BUCKETS, dtype=np.uint8)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.concatenate([[True], bucket[1:] != bucket[:-1]])  # sorted: the least of each bucket
        rest = hashes[first] << np.uint64(BUCKET_BITS)
        top = (rest >> np.uint64(32)).astype(np.float64)
        zeros = np.minimum(32 - np.frexp(top)[1], ZEROS)
        mantissa = (rest << (zeros.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - MANTISSA)
        regs[bucket[first]] = ((zeros + 1) << MANTISSA) + mantissa.astype(np.int64)
    return regs


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimates corrected for chance agreement, buckets used) of rows of registers."""
    used = (a > 0) | (b > 0)
    n = used.sum(axis=1)
    same = ((a == b) & used).sum(axis=1) / np.maximum(n, 1)
    chance = 1.0 / (3 * (1 << MANTISSA))  # two independent minima: equal zeros (1/3), then equal mantissas
    return np.maximum((same - chance) / (1 - chance), 0.0), n


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers whose empty buckets borrow that of the full bucket they prefer by a fixed random order."""
    full, empty = np.flatnonzero(regs), np.flatnonzero(regs == 0)
    if not len(empty):
        return regs
    out = regs.copy()
    out[empty] = regs[full[_PREFER[empty[:, None], full].argmin(axis=1)]]
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """64-bit key of each band."""
    n = BUCKETS // ROWS
    g = filled(regs)[:n * ROWS].reshape(n, ROWS).astype(np.uint64)
    packed = (g << (np.arange(ROWS, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)
    return mix(packed + (np.arange(1, n + 1, dtype=np.uint64) << np.uint64(56)))


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: doc_id, k1, k2 (row key), n_shingles, component (internal id, NULL without words),
    component_id (least doc_id reachable), kept (doc_id = component_id).

    Linked are documents with 100 * intersection >= percent * union.  NULL and empty texts have no set and no
    links; repeated rows have equal sets; a NULL id counts as above all ids, and is kept where no id is
    reachable.  An empty table gives no rows.
    """
    k1, k2 = row_key(id_col, text_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), k1, k2, F.col(text_col).cast("binary").alias("data"))

    def sign(batches):
        for b in batches:
            n, h1, h2, sig = [], [], [], []
            for data in b.column(3):
                s = shingles(data.as_py() or b"", size)
                n.append(len(s))
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                h1.append(int.from_bytes(d[:8], "little", signed=True))
                h2.append(int.from_bytes(d[8:], "little", signed=True))
                sig.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(h1, pa.int64()),
                                              pa.array(h2, pa.int64()), pa.array(sig, pa.binary())],
                                             names=["doc_id", "k1", "k2", "n", "h1", "h2", "sig"])

    signed = pin(src.mapInArrow(sign, "doc_id long, k1 long, k2 long, n long, h1 long, h2 long, sig binary"), "signed")
    # equal sets are one vertex; its text is that of the least row key
    sets = pin(signed.filter("n > 0").groupBy("h1", "h2")
               .agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min(F.struct("k1", "k2", "sig")).alias("r"))
               .select("h1", "h2", "doc_id", "n", "r.k1", "r.k2", "r.sig").withColumn("vid", F.monotonically_increasing_id()),
               "sets")
    comp = _components(src, sets, percent, size)
    # the least doc_id of a component, over its vertices; a vertex without links is its own
    owners = sets.join(comp, "vid", "left").select("h1", "h2", "doc_id", F.coalesce("comp", "vid").alias("component"))
    # pinned, so that the join deals both sides itself and a large component can be split
    least = pin(owners.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    placed = owners.join(least, "component").select("h1", "h2", "component", "component_id")
    out = signed.select("doc_id", "k1", "k2", "n", "h1", "h2").join(placed, ["h1", "h2"], "left")
    cid = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "component", cid.alias("component_id"),
                      F.col("doc_id").eqNullSafe(cid).alias("kept"))


def _components(src: DataFrame, sets: DataFrame, percent: int, size: int) -> DataFrame:
    def key(batches):
        for b in batches:
            got = [bands(np.frombuffer(s.as_buffer(), np.uint8)) for s in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(got).view(np.int64) if got else [], pa.int64()),
                 pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(g) for g in got]), pa.int64())],
                names=["band", "vid"])

    keyed = sets.select("vid", "sig").mapInArrow(key, "band long, vid long")
    shared = keyed.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1")
    met = pin(keyed.join(shared, "band"), "met")
    # how many others a vertex meets: near the middle of a group of copies it is greatest
    degree = met.groupBy("vid").agg(F.sum("m").alias("degree"))
    members = pin(met.select("band", "vid").join(degree, "vid").join(sets.select("vid", "n"), "vid"), "members")

    # full sets of the candidates: one row per vertex of a shared band
    wanted = sets.join(members.select("vid").distinct(), "vid").select("vid", "sig", "k1", "k2")
    full = pin(_first_text(src.join(wanted, ["k1", "k2"])).mapInArrow(_set_writer(size), "vid long, sig binary, hashes binary"),
               "candidate-sets")

    tested = links = comp = None
    for step in range(STAR_ROUNDS + 1):
        pairs = _star(members, comp, step, percent) if step < STAR_ROUNDS else _rest(members, comp, full, percent)
        pairs = pin(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = pin(_confirmed(_likely(pairs, full, percent), full, percent), "confirmed")
        if links is None or found.limit(1).count():
            links = found if links is None else links.unionByName(found)
            comp = components(links)
    return comp


def _labelled(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Members of bands that still hold two components or more, with their component."""
    if comp is None:
        return members.withColumn("comp", F.col("vid"))
    rows = members.join(comp, "vid", "left").withColumn("comp", F.coalesce("comp", "vid"))
    mixed = rows.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("band")
    return rows.join(mixed, "band", "left_semi")


def _near_sizes(a: str, b: str, percent: int):
    """Sets of other sizes cannot be linked."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _star(members: DataFrame, comp: DataFrame | None, step: int, percent: int) -> DataFrame:
    """Each vertex with one representative of its bands, in another component: one pair a vertex at most.

    A band's members of about equal size have one representative: in the first rounds the one that meets most
    others, then one by a hash that differs by round.  Size classes overlap from round to round.
    """
    rows = _labelled(members, comp).withColumn(
        "class", F.floor(F.log("n") / float(np.log(100 / percent)) + F.lit(step % 2) / 2))
    order = (-F.col("degree")) if step < 2 else F.xxhash64(F.lit(step), "vid")
    rank = F.struct(order.alias("o"), F.col("vid").alias("rep"), F.col("comp").alias("rc"), F.col("n").alias("rn"))
    reps = rows.groupBy("band", "class").agg(F.min(rank).alias("r"))
    best = rows.join(reps, ["band", "class"]).filter((F.col("comp") != F.col("r.rc")) & _near_sizes("n", "r.rn", percent)) \
        .groupBy("vid").agg(F.min("r").alias("r"))
    return best.select(F.least("vid", "r.rep").alias("a"), F.greatest("vid", "r.rep").alias("b")).distinct()


def _rest(members: DataFrame, comp: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs across components among the members that are still apart, by their rarest shingles.

    Two sets of the wanted similarity share ``percent`` of either, so they meet in the rarest rest of each: order all
    shingles by how many of these sets hold them; without a common one before the last ``percent`` of its set a pair cannot be
    linked.  Documents that share a frequent passage thus meet only if their rare parts do.  ``r`` counts from a
    set's most frequent shingle, so that from a common one on two sets have the lesser ``r`` in common at most.
    """
    apart = pin(_labelled(members, comp).groupBy("vid").agg(F.min("comp").alias("comp"), F.min("n").alias("n")), "apart")
    sets = full.select("vid", "hashes").join(apart.select("vid"), "vid", "left_semi").mapInArrow(_exploded, "vid long, h long")
    held = sets.groupBy("h").agg(F.count("*").alias("held")).filter("held > 1")
    by_vertex = Window.partitionBy("vid").orderBy(F.desc("held"), F.desc("h"))
    rare = sets.join(held, "h").withColumn("r", F.row_number().over(by_vertex)).join(apart, "vid") \
        .filter(100 * F.col("r") >= percent * F.col("n")).select("h", "vid", "comp", "n", "r")
    rare = pin(rare, "rare")
    return _across(rare, percent)


def _meeting(rare: DataFrame, percent: int) -> DataFrame:
    """(h, comp_x, comp_y): pairs of components that hold a shingle, unless the bounds exclude all their members."""
    held = rare.groupBy("h", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("r").alias("top"))
    one, two = (held.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("comp", "lo", "hi", "top")]) for side in "xy")
    on = (F.col("comp_x") < F.col("comp_y")) & (100 * F.col("hi_x") >= percent * F.col("lo_y")) \
        & (100 * F.col("hi_y") >= percent * F.col("lo_x")) \
        & ((100 + percent) * F.least("top_x", "top_y") >= percent * (F.col("lo_x") + F.col("lo_y")))
    return one.join(two, "h").filter(on).select("h", *[f"{c}_{side}" for side in "xy" for c in ("comp", "lo", "hi", "top")])


def _can_meet(rare: DataFrame, meeting: DataFrame, side: str, other: str, percent: int) -> DataFrame:
    """``meeting`` with the rows of one side's component that the bounds of the other component leave: a large component
    brings in only members that could be linked with some member of the other."""
    rows = rare.select(F.col("h").alias("_h"), *[F.col(c).alias(f"{c}_{side}") for c in ("vid", "n", "r")], F.col("comp").alias("_comp"))
    n, r, low, high, top = (F.col(c) for c in (f"n_{side}", f"r_{side}", f"lo_{other}", f"hi_{other}", f"top_{other}"))
    on = (F.col("h") == F.col("_h")) & (F.col(f"comp_{side}") == F.col("_comp")) & (100 * n >= percent * low) & (100 * high >= percent * n) \
        & ((100 + percent) * F.least(r, top) >= percent * (n + low))
    return meeting.join(rows, on).drop("_h", "_comp")


def _across(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs of vertices in two components that share one of these shingles; rows of one component never meet each other."""
    meeting = pin(_meeting(rare, percent), "meeting")
    one = _can_meet(rare, meeting, "x", "y", percent)
    # the second side's rows meet those of the first one by one: the bounds are those of the row itself
    one = one.drop("lo_x", "hi_x", "top_x").withColumns({"lo_x": F.col("n_x"), "hi_x": F.col("n_x"), "top_x": F.col("r_x")})
    return _can_meet(rare, one, "y", "x", percent) \
        .select(F.least("vid_x", "vid_y").alias("a"), F.greatest("vid_x", "vid_y").alias("b")).distinct()


def _exploded(batches):
    """(vid, h) of every shingle of the sets, a set at a time."""
    for b in batches:
        for vid, hashes in zip(b.column(0).to_pylist(), b.column(1)):
            h = np.frombuffer(hashes.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), vid)), pa.array(h)], names=["vid", "h"])


def _first_text(rows: DataFrame) -> DataFrame:
    """Repeated rows share a key: one of their equal texts for each vertex."""
    return rows.select("vid", "sig", "data").dropDuplicates(["vid"])


def _set_writer(size: int):
    def write(batches):
        for b in batches:
            sig = [x.as_py()[:ESTIMATE] for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sig, pa.binary()), pa.array([shingles(x.as_py(), size).tobytes() for x in b.column(2)], pa.binary())],
                names=["vid", "sig", "hashes"])
    return write


def _both(pairs: DataFrame, full: DataFrame, col: str) -> DataFrame:
    """Pairs with ``col`` of both vertices; that of `b` travels to the shuffle on `a`."""
    one = full.select(F.col("vid").alias("a"), F.col(col).alias("x"))
    two = full.select(F.col("vid").alias("b"), F.col(col).alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y")


def _likely(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimate is at most seven standard errors below the threshold."""
    p = percent / 100

    def judge(batches):
        for b in batches:
            regs = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, ESTIMATE) for i in (2, 3)]
            e, n = estimate(*regs)
            yield b.filter(pa.array(e >= p - 7 * np.sqrt(p * (1 - p) / np.maximum(n, 1)))).select(["a", "b"])

    return _both(pairs, full, "sig").mapInArrow(judge, "a long, b long")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs linked by their full sets."""

    def judge(batches):
        for x in batches:
            linked = []
            for ha, hb in zip(x.column(2), x.column(3)):
                u, v = np.frombuffer(ha.as_buffer(), np.uint64), np.frombuffer(hb.as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                linked.append(100 * both >= percent * (len(u) + len(v) - both))
            yield x.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    return _both(pairs, full, "hashes").mapInArrow(judge, "a long, b long")


def keep_one(docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component left (the least id, then the least text hash); documents without
    words stay, each of their repeated rows too.  All columns of ``docs`` come back, whatever their names."""
    verdict = near_duplicates(docs, percent, size, id_col, text_col)
    big = F.when(F.col("k1") == NO_ID, F.lit((1 << 63) - 1)).otherwise(F.col("k1"))  # a NULL id comes last
    chosen = verdict.filter("n_shingles > 0").groupBy("component") \
        .agg(F.min(F.struct(big.alias("o"), "k1", "k2")).alias("r")).select("r.k1", "r.k2")
    empty = verdict.filter("n_shingles = 0").select("k1", "k2")
    x = spare(docs, "_qp")
    stay = chosen.withColumn("one", F.lit(True)).unionByName(empty.distinct().withColumn("one", F.lit(False))) \
        .select(F.col("k1").alias(f"{x}1"), F.col("k2").alias(f"{x}2"), F.col("one").alias(f"{x}3"))
    k1, k2 = row_key(id_col, text_col)
    src = docs.withColumns({f"{x}a": k1, f"{x}b": k2})
    left = pin(src.join(stay, (F.col(f"{x}a") == F.col(f"{x}1")) & (F.col(f"{x}b") == F.col(f"{x}2"))), "near-left")
    one = left.filter(f"`{x}3`").dropDuplicates([f"{x}a", f"{x}b"])
    return one.unionByName(left.filter(f"NOT `{x}3`")).select(*[F.col(f"`{c}`") for c in docs.columns])

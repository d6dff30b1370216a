"""Merkle manifest of a table, with a version of the tree for each altered leaf.

Leaves of a group ascend by id; every ``FAN`` consecutive nodes of a level become the hash of their hex digests (the last run of a
level may be shorter, even one), until one node is left: the group's subroot.  Subroots, ordered by group, give the root likewise.

A tree is cut into aligned blocks of ``FAN ** HEIGHT`` nodes.  Each is a persistent tree (:class:`Block`) inside one task: an
altered leaf makes a version that copies the leaf's ancestors within its block and shares every other node.  The roots of the blocks
are the nodes of the next round, so a group of any size takes logarithmically many rounds of blocks of bounded size, and a
version goes on above its block along the siblings of the block's root (its ancestors there are again the only new nodes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qplate.llm.common import numbered, pin
from qplate.llm.lines import host

FAN, HEIGHT = 3, 6  # 729 nodes a block
PATH = "array<struct<before: string, after: string>>"  # hex digests of the siblings on either side, a level each
_NODE = "tree string, block long, pos long, size long, digest string, id long, changed string"


def field_text(value: Column) -> Column:
    """``-`` for NULL, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


class Block:
    """Persistent tree over hex digests; nodes are only ever added, a version is the number of its root."""

    def __init__(self, digests: list[str], height: int | None):
        """``height`` levels above the leaves; None: until one node is left."""
        self.nodes: list[tuple[str, tuple[int, ...]]] = [(d, ()) for d in digests]
        row, self.height = list(range(len(digests))), 0
        while self.height < height if height is not None else len(row) > 1:
            row = [self._join(row[i:i + FAN]) for i in range(0, len(row), FAN)]
            self.height += 1
        self.root = row[0]

    def _join(self, children: list[int]) -> int:
        text = "".join(self.nodes[c][0] for c in children)
        self.nodes.append((hashlib.sha256(text.encode()).hexdigest(), tuple(children)))
        return len(self.nodes) - 1

    def digest(self, node: int) -> str:
        return self.nodes[node][0]

    def replaced(self, leaf: int, digest: str, node: int | None = None, height: int | None = None) -> int:
        """Root of a version with another digest at ``leaf``: copies of its ancestors, all else shared."""
        if height is None:
            node, height = self.root, self.height
        if height == 0:
            self.nodes.append((digest, ()))
            return len(self.nodes) - 1
        span = FAN ** (height - 1)
        children = list(self.nodes[node][1])
        children[leaf // span] = self.replaced(leaf % span, digest, children[leaf // span], height - 1)
        return self._join(children)

    def siblings(self, leaf: int) -> list[dict[str, str]]:
        """Those of each level, from the leaf up."""
        out, node = [], self.root
        for height in range(self.height, 0, -1):
            span = FAN ** (height - 1)
            children, k = self.nodes[node][1], leaf // span
            out.append({"before": "".join(self.digest(c) for c in children[:k]), "after": "".join(self.digest(c) for c in children[k + 1:])})
            node, leaf = children[k], leaf % span
        return out[::-1]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (tree, block) of a partition sorted by them: the nodes of one block and at most one row of its upper path."""
    rows: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and (r["block"] != rows[0]["block"] or r["tree"] != rows[0]["tree"]):
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _built(rows: list[dict], height: int) -> Block:
    return Block([r["digest"] for r in rows], None if rows[0]["size"] <= FAN ** height else height)


def _roots(height: int):
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])

    def run(batches):
        for rows in _blocks(batches):
            b = _built(rows, height)
            yield pa.RecordBatch.from_pylist([{"tree": rows[0]["tree"], "pos": rows[0]["block"], "size": -(-rows[0]["size"] // FAN ** height),
                                               "digest": b.digest(b.root)}], schema=schema)
    return run


_PATH_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_CLIMBED = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("id", pa.int64()), ("changed", pa.string()),
                      ("inside", _PATH_TYPE), ("top", pa.string()), ("upper", _PATH_TYPE), ("subroot", pa.string()), ("root", pa.string())])


def _climbed(height: int):
    def run(batches):
        for rows in _blocks(batches):
            above, rows = rows[0], rows[1:]
            b, out = _built(rows, height), []
            for i, r in enumerate(rows):
                version = b.root if r["changed"] is None else b.replaced(i, r["changed"])
                out.append({**{k: r[k] for k in ("tree", "pos", "digest", "id", "changed")}, "inside": b.siblings(i), "top": b.digest(version),
                            "upper": above["path"], "subroot": above["subroot"], "root": above["root"]})
            yield pa.RecordBatch.from_pylist(out, schema=_CLIMBED)
    return run


def _with_blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN ** height))


def _upper_nodes(nodes: DataFrame, height: int) -> DataFrame:
    """Roots of the blocks: the nodes of the next round."""
    cut = _with_blocks(nodes, height).select("tree", "block", "pos", "size", "digest").repartition("tree", "block") \
        .sortWithinPartitions("tree", "block", "pos")
    return pin(cut.mapInArrow(_roots(height), "tree string, pos long, size long, digest string"), "merkle-roots")


def _climb(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Each node with its siblings inside its block, the digest of its version there, and what lies above the block."""
    none = lambda *cols: [F.lit(None).cast(t).alias(c) for c, t in cols]
    below = _with_blocks(nodes, height)
    for c, t in (("id", "long"), ("changed", "string")):
        if c not in below.columns:
            below = below.withColumn(c, F.lit(None).cast(t))
    below = below.select("tree", "block", F.lit(1).alias("role"), "pos", "size", "digest", "id", "changed",
                         *none(("path", PATH), ("subroot", "string"), ("root", "string")))
    above = above.select("tree", F.col("pos").alias("block"), F.lit(0).alias("role"),
                         *none(("pos", "long"), ("size", "long"), ("digest", "string"), ("id", "long"), ("changed", "string")),
                         "path", "subroot", "root")
    both = below.unionByName(above).repartition("tree", "block").sortWithinPartitions("tree", "block", "role", "pos")
    return both.mapInArrow(_climbed(height), f"tree string, pos long, digest string, id long, changed string, inside {PATH}, top string, "
                                     f"upper {PATH}, subroot string, root string")


def paths(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, pos, path, root): the siblings of each node up to its tree's root.  ``nodes``: pinned (tree, pos, size, digest)."""
    if (nodes.agg(F.max("size")).first()[0] or 0) <= 1:
        return nodes.select("tree", "pos", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    above = paths(_upper_nodes(nodes, height), height).withColumn("subroot", F.lit(None).cast("string"))
    return pin(_climb(nodes, above, height).select("tree", "pos", F.concat("inside", "upper").alias("path"), "root"), "merkle-paths")


def _folded(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def _flat(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def leaves(docs: DataFrame, fields: list[str], id_col: str, group_col: str, altered: dict[str, Column], where: Column) -> DataFrame:
    """Pinned (tree, pos, size, digest, id, changed): the leaf of each row at its place in its group's tree.

    ``changed`` is the digest with the columns of ``altered`` in place of their fields, where ``where`` holds (NULL elsewhere).
    """
    rows = docs.select(host(F.col(group_col)).alias("tree"), F.col(id_col).cast("long").alias("id"),
                       leaf_digest([F.col(c) for c in fields]).alias("digest"),
                       F.when(where, leaf_digest([altered.get(c, F.col(c)) for c in fields])).alias("changed"))
    rows = pin(rows, "merkle-leaves")  # narrow from here on; the texts are read once
    # the last key parts rows that are equal in all others, so that many copies of a row spread over tasks
    order = [(F.col("tree") != "null").asc(), F.col("tree").asc(), F.col("id").asc_nulls_first(), F.col("digest").asc(), F.col("_copy").asc()]
    placed = numbered(rows.withColumn("_copy", F.monotonically_increasing_id()), order, "merkle-order")
    groups = pin(placed.groupBy("tree").agg(F.min("_row").alias("_first"), F.count("*").alias("size")), "merkle-groups")
    return placed.join(groups, "tree").select("tree", (F.col("_row") - F.col("_first")).alias("pos"), "size", "digest", "id", "changed")


def manifest(docs: DataFrame, fields=("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id",
             group_col: str = "source", altered: dict[str, Column] | None = None, where: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root): a row per document.

    ``proof`` is the hex digests of the siblings from leaf to root; ``folded_root`` the root of the version with the row's altered
    leaf (see :func:`leaves`), or of its own leaf where it is not altered.  ``height`` is the levels of a block; it changes no result.

    A NULL group is a group of its own, before all others; NULL ids come first in a group and NULL fields hash as ``-``.
    Rows of one id ascend by digest; repeated rows are leaves of their own and interchangeable.  Texts are hashed whole where
    they are read, of any length.  An empty table has no rows.  Extra columns are not read, whatever their names.
    """
    where = F.lit(False) if where is None else F.coalesce(where, F.lit(False))
    rows = pin(leaves(docs, list(fields), id_col, group_col, altered or {}, where), "merkle-placed")
    blocks = _upper_nodes(rows, height)
    in_group = paths(blocks, height)
    subroots = in_group.filter("pos = 0").select("tree", F.col("root").alias("digest"))
    tops = numbered(subroots, [(F.col("tree") != "null").asc(), F.col("tree").asc()], "merkle-subroots")
    n_groups = tops.count()
    tops = pin(tops.select(F.lit("").alias("tree"), F.col("_row").alias("pos"), F.lit(n_groups).cast("long").alias("size"), "digest",
                           F.col("tree").alias("group")), "merkle-tops")
    over = pin(tops.join(paths(tops.drop("group"), height).select("pos", F.col("path").alias("over"), "root"), "pos")
               .select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "over", "root"), "merkle-over")
    above = in_group.drop("root").join(over, "tree").select("tree", "pos", F.concat("path", "over").alias("path"), "subroot", "root")
    out = _climb(rows, above, height)
    return out.select("id", F.col("digest").alias("leaf"), "subroot", "root", F.concat(_flat(F.col("inside")), _flat(F.col("upper"))).alias("proof"),
                      _folded(F.col("top"), F.col("upper")).alias("folded_root"))


def without_newlines(text_col: str, id_col: str) -> tuple[dict[str, Column], Column]:
    """Tampering for :func:`manifest`: texts lose their newlines where 2 divides the crc32 of the decimal id."""
    return {text_col: F.translate(F.col(text_col), "\n", "")}, F.crc32(F.col(id_col).cast("string")) % 2 == 0

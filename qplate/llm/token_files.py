"""Token ids in binary files: simple-8b blocks, a block index and a document table.

File: ``MAGIC``, the 64-bit words of all blocks, then a footer of little-endian
arrays (word offset of each block with the end, documents' id validity, ids and
token counts), an 8-byte header length before it and ``MAGIC``.  A reader fetches the footer and any
range of blocks.  Files follow ascending doc_id: file names sort in that order,
and documents inside a file stand in that order (NULL ids first, equal ids by text hash).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qplate.llm import simple8b
from qplate.llm.common import pin, shared_folder
from qplate.llm.files import AtomicFile, RangeFile
from qplate.llm.tokenization import encoder, in_slices

MAGIC = b"QPLS8B01"
MANIFEST = "path string, part long, seq long, n_docs long, n_tokens long"


class TokenFile:
    """Writer of one file; ids are coded a group of blocks at a time."""

    GROUP = simple8b.BLOCK * 1024

    def __init__(self, uri: str):
        self.out = AtomicFile(uri)
        self.out.write(MAGIC)
        self.words, self.offsets, self.docs = 0, [], []
        self.held, self.n_held, self.n_ids = [], 0, 0

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.held.append(ids)
        self.n_held += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_held >= self.GROUP:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), dtype="<u4")
        cut = len(ids) if last else len(ids) // simple8b.BLOCK * simple8b.BLOCK
        for i in range(0, cut, self.GROUP):
            words, offsets = simple8b.encode(ids[i:min(i + self.GROUP, cut)])
            self.offsets.append(offsets + self.words)
            self.out.write(words.astype("<u8").tobytes())
            self.words += len(words)
        self.held, self.n_held = [ids[cut:].tobytes()], len(ids) - cut

    def close(self) -> None:
        self._flush(True)
        offsets = np.concatenate([*self.offsets, [self.words]]).astype("<i8")
        valid = np.array([d is not None for d, _ in self.docs], dtype="u1")
        ids = np.array([d or 0 for d, _ in self.docs], dtype="<i8")
        counts = np.array([n for _, n in self.docs], dtype="<i8")
        head = json.dumps({"blocks": len(offsets) - 1, "block": simple8b.BLOCK, "docs": len(ids),
                           "ids": self.n_ids}).encode()
        foot = head + offsets.tobytes() + valid.tobytes() + ids.tobytes() + counts.tobytes()
        self.out.write(foot + struct.pack("<QQ", len(head), len(foot)) + MAGIC)
        self.out.close()


def read_file(uri: str, blocks_at_once: int = 1024):
    """(doc_id, iterator-free crc32, n_tokens) of each document of a file, block range by block range."""
    f = RangeFile(uri)
    head_len, foot_len, magic = struct.unpack("<QQ8s", f.read(f.size - 24, 24))
    if magic != MAGIC or f.read(0, 8) != MAGIC:
        raise ValueError(f"not a token file: {uri}")
    foot = f.read(f.size - 24 - foot_len, foot_len)
    head = json.loads(foot[:head_len])
    at = head_len
    offsets = np.frombuffer(foot, "<i8", head["blocks"] + 1, at)
    at += 8 * (head["blocks"] + 1)
    valid = np.frombuffer(foot, "u1", head["docs"], at)
    at += head["docs"]
    ids = np.frombuffer(foot, "<i8", head["docs"], at)
    counts = np.frombuffer(foot, "<i8", head["docs"], at + 8 * head["docs"])

    def decoded():
        for b in range(0, head["blocks"], blocks_at_once):
            lo, hi = offsets[b], offsets[min(b + blocks_at_once, head["blocks"])]
            words = np.frombuffer(f.read(8 + 8 * int(lo), 8 * int(hi - lo)), "<u8")
            yield memoryview(simple8b.decode(words).astype("<u4").tobytes())

    source, have = decoded(), memoryview(b"")
    for d in range(head["docs"]):
        need, crc = int(counts[d]) * 4, 0
        while need:
            if not len(have):
                have = next(source)
            crc = zlib.crc32(have[:need], crc)
            took = min(need, len(have))
            have, need = have[took:], need - took
        yield (int(ids[d]) if valid[d] else None), crc, int(counts[d])
    f.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None,
                      id_col: str = "doc_id", text_col: str = "text", file_ids: int = 1 << 24) -> DataFrame:
    """Encode every text, append ``end_id`` and write files in ascending ``id_col`` order.

    Returns the manifest (path, part, seq, n_docs, n_tokens, first): ``first`` counts the ids in all
    files before.  A file is closed after ``file_ids`` ids.  NULL text is empty; an empty table has an
    empty manifest.  The shuffle is one range partitioning of the texts.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    src = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("th"))
           .repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").drop("th"))

    def write(batches):
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        own = uuid.uuid4().hex  # another attempt may cut its files elsewhere; the manifest names those that count
        end, done, file = struct.pack("<I", end_id), [], None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in in_slices(batch.column(1)):
                for doc_id, got in zip(ids[first:first + len(texts)], enc.encode(texts)):
                    if file is None:
                        path = f"{folder}/part-{part:06d}-{own}-{len(done):06d}.s8b"
                        file = TokenFile(path)
                    file.add(doc_id, got + end)
                    if file.n_ids >= file_ids:
                        file.close()
                        done.append((path, part, len(done), len(file.docs), file.n_ids))
                        file = None
        if file is not None:
            file.close()
            done.append((path, part, len(done), len(file.docs), file.n_ids))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)],
                                             names=["path", "part", "seq", "n_docs", "n_tokens"])

    manifest = pin(src.mapInArrow(write, MANIFEST), "token-manifest")
    # running sums in two steps: within a partition's files, then over one row per partition
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("_t")) \
        .select("part", F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_p"))
    return (manifest.withColumn("_i", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .join(F.broadcast(parts), "part")  # one row per shuffle partition
            .select("path", "part", "seq", "n_docs", "n_tokens", (F.col("_p") + F.col("_i")).alias("first")))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (decoded from the blocks)."""

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, at = [], first
                for doc_id, crc, n in read_file(path):
                    rows.append((doc_id, at, n, crc))
                    at += n
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (manifest.select("path", "first").repartition(n, "path")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def _rows(rows):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])

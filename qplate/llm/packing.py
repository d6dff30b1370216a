"""Packing by powers of two: every document is cut into pieces of binary lengths, and equal lengths
share a bucket, so that no sequence crosses documents and nothing is padded."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qplate.llm.common import numbered, pin
from qplate.llm.tokenization import encoder, in_slices

CACHE_ENTRIES, RUN = 250_000, 1 << 20  # word pieces that a worker keeps, characters that it encodes at once: about a third of a GB at most
PIECES = "doc_id long, th long, start long, length long, ids_crc32 long, doc_tokens long"


def binary_lengths(n: int, longest: int) -> list[int]:
    """``n`` as full sequences and then descending powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int = 2048,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    ``longest`` is a power of two.  A piece of length 2^k is a sequence of its own in the bucket of that
    length, at offset 0; sequence ids number the sequences bucket by bucket (longest first), inside
    a bucket by document and start.  NULL text is empty (its end id is its only token); repeated rows are packed each;
    NULL ids stay NULL; an empty table gives no pieces.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches):
        enc, end = encoder(tokenizer_path, CACHE_ENTRIES), struct.pack("<I", end_id)
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, texts in in_slices(batch.column(1), RUN):
                rows = []
                for i, got in enumerate(enc.encode(texts), first):
                    got += end
                    n, at, view = len(got) // 4, 0, memoryview(got)
                    for size in binary_lengths(n, longest):
                        rows.append((ids[i], hashes[i], at, size, zlib.crc32(view[4 * at:4 * (at + size)]), n))
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 names=["doc_id", "th", "start", "length", "ids_crc32", "doc_tokens"])

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         F.xxhash64(text_col).alias("th")).mapInArrow(cut, PIECES)
    pieces = pin(pieces, "cut")  # range partitioning looks at its input twice
    rows = numbered(pieces, [F.desc("length"), F.asc("doc_id"), F.asc("th"), F.asc("start")], "pieces")
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                       F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                       F.col("length").alias("bucket"))

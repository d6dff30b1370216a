"""WARC records of web pages in ZIP-packaged archives, and a reader that range-reads them.

An archive is a ZIP of stored members: ``archive/data.warc.gz`` (every record a gzip member of its own) and
``indexes/index.cdxj`` (one line a record: page, offset and length in that member).  The reader parses the ZIP
directory, reads the index and fetches records by range.  Of pages with equal payloads the one with the
largest id is a response; the others are revisits that refer to it and hold no payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qplate.llm.common import pin, shared_folder
from qplate.llm.zipstore import ZipReader, ZipWriter

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"  # pages carry no fetch time; a fixed one keeps archives reproducible
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _uri(page_id) -> str:
    return "urn:page:" + ("none" if page_id is None else str(page_id))


def _clean(url: str | None) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: the HTTP head with the full length, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_uri(page_id)}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_uri(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse(data: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of a record.

    The digest is that of the payload as read, and has to be the stated one; a revisit holds no payload, its digest is the stated one.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = rest[:int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, stated = field["warc-type"], field["warc-payload-digest"].split(":", 1)[1]
    page = lambda name: None if field[name][1:-1] == _uri(None) else int(field[name][1:-1].rsplit(":", 1)[1])
    if kind == "response" and size != len(payload):
        raise ValueError("payload is cut off")
    found = payload_digest(payload) if kind == "response" else stated
    if found != stated:
        raise ValueError(f"payload digest {found} of {field['warc-record-id']} is not {stated}")
    return (page("warc-record-id"), field["warc-target-uri"], size, found, kind,
            page("warc-refers-to") if kind == "revisit" else None, payload if kind == "response" else None)


def _referred(pages: DataFrame, min_revisit_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, sha1 and, for revisits, the page they refer to."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                       F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    # pinned, so that the join deals both sides itself and a hot payload can be split
    last = pin(src.select("page_id", "sha1").groupBy("sha1").agg(F.max("page_id").alias("last")), "warc-last")
    first = F.col("last").isNull() | F.col("page_id").eqNullSafe(F.col("last")) | (F.length("payload") < min_revisit_bytes)
    return src.join(last, "sha1").select("page_id", "url", "payload", "sha1",
                                         F.when(~first, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html", archive_bytes: int = 256 << 20) -> DataFrame:
    """Write a record per row; returns the manifest (path, n_records, n_bytes).

    Payloads of fewer than ``min_revisit_bytes`` bytes are always responses.  NULL html is an empty payload, NULL urls are
    empty; a NULL page id never is the largest unless all are NULL, and then every row is a response; rows that
    repeat the largest id are responses all.  An empty table writes no archive.  Payloads are shuffled at most once,
    on their digest; the largest id of each digest is aggregated and pinned before that.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    rows = _referred(pages, min_revisit_bytes, id_col, url_col, html_col)

    def write(batches):
        # names of this attempt's own: another attempt may cut its archives elsewhere, and the manifest names those that count
        part, n_file, done, out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, [], None
        index: list[bytes] = []

        def finish():
            out.end()
            out.begin(INDEX)
            for line in index:
                out.write(line)
            out.end()
            out.close()
            done.append((path, len(index), at))
            index.clear()

        for b in batches:
            for page_id, url, payload, sha1, ref in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    path, at = f"{folder}/part-{part}-{n_file:04d}.wacz", 0
                    out, n_file = ZipWriter(path), n_file + 1
                    out.begin(DATA)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = z.compress(record(page_id, url, payload, digest, ref)) + z.flush()
                start = out.write(raw)
                at = start + len(raw)
                index.append(json.dumps({"page": page_id, "offset": start, "length": len(raw)}).encode() + b"\n")
                if at >= archive_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "n_records", "n_bytes"])

    return pin(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False, range_bytes: int = 1 << 22) -> DataFrame:
    """The records of the archives; neighbouring records are fetched in ranges of about ``range_bytes``."""

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                zipped = ZipReader(path)
                places = [json.loads(x) for x in zipped.read(INDEX).splitlines()]
                run, size = [], 0
                for p in places:
                    run.append(p)
                    size += p["length"]
                    if size >= range_bytes:
                        yield _records(zipped, run, with_payload)
                        run, size = [], 0
                if run:
                    yield _records(zipped, run, with_payload)
                zipped.close()

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInArrow(read, RECORDS)


def _records(zipped: ZipReader, run: list[dict], with_payload: bool):
    start = run[0]["offset"]
    data = zipped.read(DATA, start, run[-1]["offset"] + run[-1]["length"] - start)
    rows = []
    for p in run:
        at = p["offset"] - start
        row = parse(zlib.decompress(data[at:at + p["length"]], 31))
        rows.append(row if with_payload else (*row[:6], None))
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=[f.split()[0] for f in RECORDS.split(", ")])

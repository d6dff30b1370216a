"""Plate exports as instruments write them: one text file a plate, written by tasks into a folder that all of them reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qplate.sources.files import qualified

HEADER = "Include\tColor\tPos\tName\tCp\tConcentration\tStandard\tStatus\r\n"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path and the path inside it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_exports(wells: DataFrame, folder: str, cp_text: str = "Cp") -> DataFrame:
    """Write one export for each ``file_name`` of ``wells`` (file_name, Pos, well_ord and ``cp_text``) into ``folder``.

    Wells stand in ``well_ord`` order; a NULL Cp is left blank, a number gets a decimal comma, and a string is written as it is.  A plate is
    written by one task under a name of its own and then renamed, so a repeated attempt replaces a plate by the same
    bytes and never leaves half of one.  Returns the written plates (file_name, n_lines).
    """
    base = qualified(wells.sparkSession, folder)
    cp = F.col(cp_text).cast("string")
    if dict(wells.dtypes)[cp_text] != "string":
        cp = F.replace(cp, F.lit("."), F.lit(","))
    lines = wells.select("file_name", "well_ord", F.concat(
        F.lit("True\t255\t"), F.col("Pos"), F.lit('\t"Sample"\t'), F.coalesce(cp, F.lit("")), F.lit("\t\t0\t\r\n")).alias("line"))
    cut = lines.repartition("file_name").sortWithinPartitions("file_name", "well_ord").select("file_name", "line")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(base)
        store.create_dir(top, recursive=True)
        done: list[tuple[str, int]] = []

        def plate(name: str, held: list[str]) -> None:
            own = f"{top}/_{name}.{uuid.uuid4().hex}"  # hidden from readers
            with store.open_output_stream(own) as out:
                out.write(f"Experiment: {name}  Selected Filter: X\t\r\n{HEADER}{''.join(held)}".encode())
            store.move(own, f"{top}/{name}.txt")
            done.append((name, len(held)))

        now, held = None, []
        for batch in batches:
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != now and held:
                    plate(now, held)
                    held = []
                now = name
                held.append(line)
        if held:
            plate(now, held)
        yield pa.RecordBatch.from_pydict({"file_name": pa.array([n for n, _ in done], pa.string()),
                                          "n_lines": pa.array([k for _, k in done], pa.int64())})

    return cut.mapInArrow(write, "file_name string, n_lines long")

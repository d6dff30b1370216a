"""Files in the shared folder, written and range-read by tasks (any store pyarrow knows)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI as :func:`qplate.llm.common.shared_folder` makes it; a path without a scheme means what the
    driver's default file system makes of it, so it is qualified there and not taken for a local one here."""
    if ":/" not in uri:
        raise ValueError(f"a path without a scheme: {uri}")
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """Writes under a name of its own and renames at the end, so that a lost or repeated task attempt
    never leaves a half-written file under the final name."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = locate(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.tmp)
        self.size = 0

    def write(self, data) -> int:
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)


class RangeFile:
    """Random reads of byte ranges."""

    def __init__(self, uri: str):
        f, path = locate(uri)
        self.file = f.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        return self.file.read_at(length, start)

    def close(self) -> None:
        self.file.close()

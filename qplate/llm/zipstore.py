"""ZIP archives with stored members: a streaming writer and a range reader (ZIP64 included).

The reader fetches the end records and the central directory, resolves a member's place from its local
header and then reads any byte range of it; nothing is extracted.
"""

from __future__ import annotations

import struct
import zlib

from qplate.llm.files import AtomicFile, RangeFile

LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
U16, U32 = 0xFFFF, 0xFFFFFFFF


class ZipWriter:
    """Members are written one after another; sizes and checksums follow each in a data descriptor.

    ``force64`` writes ZIP64 records even where they are not needed.
    """

    def __init__(self, uri: str, force64: bool = False):
        self.out, self.force64, self.members, self.open_member = AtomicFile(uri), force64, [], None

    def begin(self, name: str) -> None:
        raw = name.encode()
        at = self.out.write(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x808, 0, 0, 0x21, 0, U32, U32, len(raw), 20)
                            + raw + struct.pack("<HHQQ", 1, 16, 0, 0))
        self.open_member = [raw, at, 0, 0]

    def write(self, data: bytes) -> int:
        """Append to the open member; its offset there."""
        m = self.open_member
        at, m[2], m[3] = m[2], m[2] + len(data), zlib.crc32(data, m[3])
        self.out.write(data)
        return at

    def end(self) -> None:
        _, _, size, crc = self.open_member
        self.out.write(struct.pack("<IIQQ", 0x08074B50, crc, size, size))  # data descriptor
        self.members.append(self.open_member)
        self.open_member = None

    def close(self) -> None:
        start = self.out.size
        for raw, at, size, crc in self.members:
            wide = self.force64 or max(at, size) >= U32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            s, o = (U32, U32) if wide else (size, at)
            self.out.write(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x808, 0, 0, 0x21, crc, s, s, len(raw),
                                       len(extra), 0, 0, 0, 0, o) + raw + extra)
        length, n = self.out.size - start, len(self.members)
        if self.force64 or max(start, length) >= U32 or n >= U16:
            at = self.out.write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, start))
            self.out.write(struct.pack("<IIQI", LOCATOR, 0, at, 1))
            n, length, start = U16, U32, U32
        self.out.write(struct.pack("<IHHHHIIH", END, 0, 0, n, n, length, start, 0))
        self.out.close()


class ZipReader:
    def __init__(self, uri: str):
        self.file = RangeFile(uri)
        self.members = {name: place for name, *place in self._directory()}  # name -> [method, size, header offset]
        self.starts: dict[str, int] = {}

    def _directory(self):
        tail = self.file.read(max(0, self.file.size - 22 - U16), min(self.file.size, 22 + U16))
        base = self.file.size - len(tail)
        at = tail.rfind(struct.pack("<I", END))
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(struct.pack("<I", END), 0, at)  # the mark inside a comment
        if at < 0:
            raise ValueError("not a ZIP archive")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if n == U16 or length == U32 or start == U32:
            mark, _, place, _ = struct.unpack("<IIQI", self.file.read(base + at - 20, 20))
            if mark != LOCATOR:
                raise ValueError("ZIP64 locator missing")
            mark, _, _, _, _, _, _, n, length, start = struct.unpack("<IQHHIIQQQQ", self.file.read(place, 56))
            if mark != END64:
                raise ValueError("ZIP64 end record missing")
        data, at = self.file.read(start, length), 0
        for _ in range(n):
            h = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
            if h[0] != CENTRAL:
                raise ValueError("central directory is damaged")
            method, packed, size, n_name, n_extra, n_note, offset = h[4], h[8], h[9], h[10], h[11], h[12], h[16]
            name = data[at + 46:at + 46 + n_name].decode()
            extra = data[at + 46 + n_name:at + 46 + n_name + n_extra]
            wide = _wide(extra)
            if size == U32:
                size, = struct.unpack_from("<Q", wide)
                wide = wide[8:]
            if packed == U32:
                wide = wide[8:]
            if offset == U32:
                offset, = struct.unpack_from("<Q", wide)
            yield name, method, size, offset
            at += 46 + n_name + n_extra + n_note

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        """A byte range of a stored member."""
        method, size, offset = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        if name not in self.starts:
            h = struct.unpack("<IHHHHHIIIHH", self.file.read(offset, 30))
            if h[0] != LOCAL:
                raise ValueError("local header is damaged")
            self.starts[name] = offset + 30 + h[9] + h[10]
        length = size - start if length is None else min(length, size - start)
        return self.file.read(self.starts[name] + start, length)

    def close(self) -> None:
        self.file.close()


def _wide(extra: bytes) -> bytes:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return extra[at + 4:at + 4 + n]
        at += 4 + n
    return b""

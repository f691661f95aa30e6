"""ZIP archives of stored members, by range: a writer and a reader.

The reader fetches the tail of a file, follows the end record (the ZIP64 one
when present) to the central directory, and then reads byte ranges of stored
members in place; nothing is extracted.  Only the ranges asked for are read.
"""

from __future__ import annotations

import struct
import zlib

from statuta.llm.shards import resolve

_LOCAL, _CENTRAL, _END, _END64, _AT64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF
#: 1980-01-01, the first date that the format can express.
_DATE = 0x21


def pack(members: list[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """An archive of stored members; with zip64 the 64-bit fields carry all sizes."""
    out, entries = bytearray(), []
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(out)
        big = zip64 or len(data) >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = _FULL32 if big else len(data)
        out += struct.pack("<4sHHHHHIIIHH", _LOCAL, 45, 0x800, 0, 0, _DATE, crc, size, size, len(raw), len(extra)) + raw + extra
        out += data
        entries.append((raw, crc, len(data), at))
    start = len(out)
    for raw, crc, size, at in entries:
        big = zip64 or max(size, at) >= _FULL32
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
        s, a = (_FULL32, _FULL32) if big else (size, at)
        out += struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45, 0x800, 0, 0, _DATE, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, a) + raw + extra
    length, n = len(out) - start, len(entries)
    if zip64 or max(start, length) >= _FULL32 or n >= _FULL16:
        end = len(out)
        out += struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, length, start)
        out += struct.pack("<4sIQI", _AT64, 0, end, 1)
        n, length, start = _FULL16, _FULL32, _FULL32
    return bytes(out + struct.pack("<4sHHHHIIH", _END, 0, 0, n, n, length, start, 0))


class ZipReader:
    """The stored members of an archive; close() or use as a context manager."""

    def __init__(self, uri: str):
        fs, path = resolve(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.members = dict(self._directory())

    def __enter__(self) -> ZipReader:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.file.close()

    def _read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("a range outside the archive")
        return self.file.read_at(n, at)

    def _directory(self) -> list[tuple[str, tuple[int, int, int, int]]]:
        """(name, (local header, stored size, method, crc)) of each member."""
        tail_at = max(0, self.size - (22 + _FULL16))
        tail = self._read(tail_at, self.size - tail_at)
        end = len(tail)
        while True:  # a comment may hold the mark: its length must reach the end of the file
            end = tail.rfind(_END, 0, end)
            if end < 0:
                raise ValueError("no end record: not a ZIP archive")
            if end + 22 <= len(tail) and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
                break
        *_, n, length, start, _ = struct.unpack_from("<4sHHHHIIH", tail, end)
        mark = tail_at + end - 20
        if mark >= 0 and (at64 := self._read(mark, 20))[:4] == _AT64:
            record = self._read(struct.unpack("<4sIQI", at64)[2], 56)
            if record[:4] != _END64:
                raise ValueError("a damaged ZIP64 end record")
            n, length, start = struct.unpack("<4sQHHIIQQQQ", record)[7:]
        raw, at, found = self._read(start, length), 0, []
        for _ in range(n):
            h = struct.unpack_from("<4sHHHHHHIIIHHHHHII", raw, at)
            if h[0] != _CENTRAL:
                raise ValueError("a damaged central directory")
            method, crc, packed, size, names, extras, comment, local = h[4], h[7], h[8], h[9], h[10], h[11], h[12], h[16]
            name = raw[at + 46 : at + 46 + names].decode("utf-8", "replace")
            extra = raw[at + 46 + names : at + 46 + names + extras]
            while len(extra) >= 4:
                tag, width = struct.unpack_from("<HH", extra)
                if tag == 1:  # 64-bit values stand for the full fields, in this order
                    values = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                    size = next(values) if size == _FULL32 else size
                    packed = next(values) if packed == _FULL32 else packed
                    local = next(values) if local == _FULL32 else local
                extra = extra[4 + width :]
            found.append((name, (local, packed, method, crc)))
            at += 46 + names + extras + comment
        return found

    def start(self, name: str) -> int:
        """Where the bytes of a stored member begin."""
        local, _, method, _ = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed, so it has no ranges")
        head = self._read(local, 30)
        if head[:4] != _LOCAL:
            raise ValueError("a damaged local header")
        names, extras = struct.unpack_from("<HH", head, 26)
        return local + 30 + names + extras

    def read(self, name: str) -> bytes:
        """A whole member, checked."""
        data = self._read(self.start(name), self.members[name][1])
        if zlib.crc32(data) != self.members[name][3]:
            raise ValueError(f"{name} is damaged")
        return data

    def ranges(self, name: str, wanted: list[tuple[int, int]], join: int = 1 << 22):
        """The bytes of (offset, length) ranges in order; neighbours are fetched together."""
        base, size, i = self.start(name), self.members[name][1], 0
        while i < len(wanted):
            lo, j = wanted[i][0], i
            while j < len(wanted) and wanted[j][0] >= lo and (j == i or wanted[j][0] + wanted[j][1] - lo <= join):
                j += 1
            hi = max(a + n for a, n in wanted[i:j])
            if lo < 0 or hi > size:
                raise ValueError("a range outside the member")
            data = self._read(base + lo, hi - lo)
            for a, n in wanted[i:j]:
                yield data[a - lo : a - lo + n]
            i = j

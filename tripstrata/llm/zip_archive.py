"""ZIP-packaged web archives: stored members found through the central directory, records by byte range.

Nothing is extracted. A package holds ``archive/data.warc`` and ``indexes/index.cdxj``, both
stored without compression, so a record's bytes lie at a known offset of the ZIP file.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs

ReadAt = Callable[[int, int], bytes]

# Record signatures of the ZIP format, and the marker that sends a reader to the ZIP64 fields.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
CHUNK = 1 << 20


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path; every executor reaches shared ones the same way."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def directory_end(read: ReadAt, size: int) -> tuple[int, int, int]:
    """``(offset, length, entries)`` of the central directory."""
    tail_size = min(size, 22 + FULL16)
    tail = read(size - tail_size, tail_size)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if entries == FULL16 or length == FULL32 or offset == FULL32:
        end = size - tail_size + at
        locator = read(end - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    return offset, length, entries


def members(read: ReadAt, size: int) -> Iterator[Member]:
    """Entries of the central directory, read piece by piece."""
    offset, length, entries = directory_end(read, size)
    buffer, stop = b"", offset + length
    for _ in range(entries):
        while True:
            if len(buffer) >= 46:
                name_size, extra_size, note_size = struct.unpack_from("<HHH", buffer, 28)
                whole = 46 + name_size + extra_size + note_size
                if len(buffer) >= whole:
                    break
            piece = read(offset, min(CHUNK, stop - offset)) if offset < stop else b""
            if not piece:
                raise ValueError("central directory is cut off")
            buffer, offset = buffer + piece, offset + len(piece)
        if buffer[:4] != ENTRY:
            raise ValueError("not a central directory entry")
        method = struct.unpack_from("<H", buffer, 10)[0]
        packed, plain = struct.unpack_from("<II", buffer, 20)
        header = struct.unpack_from("<I", buffer, 42)[0]
        name = buffer[46 : 46 + name_size].decode()
        plain, packed, header = wide_fields(buffer[46 + name_size : 46 + name_size + extra_size], plain, packed, header)
        yield Member(name, method, plain, packed, header)
        buffer = buffer[whole:]


def wide_fields(extra: bytes, plain: int, packed: int, header: int) -> tuple[int, int, int]:
    """Sizes and offset, taken from the ZIP64 field where the short ones are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body, place = extra[at + 4 : at + 4 + size], 0
            values = []
            for value in (plain, packed, header):
                if value == FULL32:
                    value, place = struct.unpack_from("<Q", body, place)[0], place + 8
                values.append(value)
            return values[0], values[1], values[2]
        at += 4 + size
    return plain, packed, header


def data_offset(read: ReadAt, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    local = read(member.header, 30)
    if local[:4] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    name_size, extra_size = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + name_size + extra_size


def index_lines(read: ReadAt, start: int, size: int) -> Iterator[dict]:
    """JSON lines of an index member, read in pieces."""
    rest, at = b"", 0
    while at < size:
        piece = read(start + at, min(CHUNK, size - at))
        at += len(piece)
        *lines, rest = (rest + piece).split(b"\n")
        yield from (json.loads(line) for line in lines if line)
    if rest:
        yield json.loads(rest)

"""Reads ZIP packages by ranges: central and ZIP64 directories, and where stored members lie.

Nothing is extracted: a stored member is a range of the package, and so is any part of it.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs

#: Gives `length` bytes from a place of a file, or fewer at its end.
ReadAt = Callable[[int, int], bytes]

STORED, DEFLATED = 0, 8
# Fixed values of the ZIP format: signatures, fixed sizes of records, marks of fields kept in ZIP64 records.
_END, _END64, _LOCATOR, _ENTRY, _HEADER = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_END_SIZE, _END64_SIZE, _LOCATOR_SIZE, _ENTRY_SIZE, _HEADER_SIZE = 22, 56, 20, 46, 30
_FULL16, _FULL32, _ZIP64_EXTRA = 0xFFFF, 0xFFFFFFFF, 1
_LONGEST_COMMENT = 0xFFFF
#: Bytes of a directory that are read at a time.
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Member:
    """A file of a package as its directory tells it; `header_at` is the place of its local header."""

    name: str
    method: int
    packed_size: int
    size: int
    header_at: int
    encrypted: bool


def open_file(uri: str):
    """The file for reading at any place, on any file system that a URI names to Arrow."""
    system, path = file_system(uri)
    return system.open_input_file(path)


@functools.lru_cache(maxsize=64)
def _system_of(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    root, _, name = uri.rpartition("/")
    system, path = _system_of(root or "/")
    return system, f"{path.rstrip('/')}/{name}"


def reader(file) -> ReadAt:
    return lambda at, length: file.read_at(length, at)


def members(read_at: ReadAt, size: int) -> Iterator[Member]:
    """The files of a package of `size` bytes, in the order of its directory."""
    count, length, start = _directory(read_at, size)
    held, at = b"", start
    for _ in range(count):
        entry, held, at = _take(read_at, held, at, start + length, _ENTRY_SIZE)
        if entry[:4] != _ENTRY:
            raise ValueError("the directory of the package is damaged")
        flags, method = struct.unpack_from("<HH", entry, 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", entry, 20)
        (header_at,) = struct.unpack_from("<I", entry, 42)
        tail, held, at = _take(read_at, held, at, start + length, n_name + n_extra + n_comment)
        wide = _zip64_values(tail[n_name : n_name + n_extra])
        # The extra field holds only the values that don't fit, always in this order.
        plain, packed, header_at = (next(wide) if value == _FULL32 else value for value in (plain, packed, header_at))
        name = tail[:n_name].decode("utf-8" if flags & 0x800 else "cp437")
        yield Member(name, method, packed, plain, header_at, bool(flags & 1))


def stored_at(read_at: ReadAt, member: Member) -> int:
    """Place of a stored member's first byte; its local header has names and extras of its own length."""
    if member.method != STORED or member.encrypted:
        raise ValueError(f"{member.name} is not stored as it is")
    return _content_at(read_at, member)


def content(read_at: ReadAt, member: Member) -> bytes:
    """A small member in full, stored or deflated."""
    if member.encrypted or member.method not in (STORED, DEFLATED):
        raise ValueError(f"{member.name} cannot be read")
    packed = read_at(_content_at(read_at, member), member.packed_size)
    return packed if member.method == STORED else zlib.decompress(packed, -zlib.MAX_WBITS)


def _content_at(read_at: ReadAt, member: Member) -> int:
    header = read_at(member.header_at, _HEADER_SIZE)
    if header[:4] != _HEADER:
        raise ValueError(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header_at + _HEADER_SIZE + n_name + n_extra


def _directory(read_at: ReadAt, size: int) -> tuple[int, int, int]:
    """Entries, bytes and place of the directory, from the end record or its ZIP64 form."""
    tail_at = max(0, size - _END_SIZE - _LONGEST_COMMENT)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(_END)
    # A comment may hold the signature; the true end record's comment ends with the file.
    while at >= 0 and (at + _END_SIZE > len(tail) or at + _END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("this is no ZIP package")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    locator = read_at(tail_at + at - _LOCATOR_SIZE, _LOCATOR_SIZE) if tail_at + at >= _LOCATOR_SIZE else b""
    if locator[:4] == _LOCATOR and (count == _FULL16 or _FULL32 in (length, start)):
        end64 = read_at(struct.unpack_from("<Q", locator, 8)[0], _END64_SIZE)
        if end64[:4] != _END64:
            raise ValueError("the package names a ZIP64 directory that it doesn't have")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    return count, length, start


def _take(read_at: ReadAt, held: bytes, at: int, end: int, n: int) -> tuple[bytes, bytes, int]:
    """The next `n` bytes, what is read beyond them, and the place behind that."""
    while len(held) < n:
        more = read_at(at, min(max(_CHUNK, n), end - at))
        if not more:
            raise ValueError("the directory of the package ends early")
        held, at = held + more, at + len(more)
    return held[:n], held[n:], at


def _zip64_values(extra: bytes) -> Iterator[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == _ZIP64_EXTRA:
            yield from struct.unpack_from(f"<{length // 8}Q", extra, at + 4)
        at += 4 + length
    raise ValueError("the package lacks a ZIP64 value")

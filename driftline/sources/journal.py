"""Binary journal files: entries with their time and three fields, and the log lines made of them.

Objects follow the header one by one, aligned to eight bytes.  A data object holds ``NAME=value``, perhaps
compressed; an entry names its data objects by their offsets.
"""

from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import BinaryIO

# Fixed values of the file format.
SIGNATURE = b"LPKSHHRH"
HEADER_MIN = 104
DATA, ENTRY = 1, 3
XZ, ZSTD = 1, 4
COMPACT = 16
DATA_FIXED, DATA_FIXED_COMPACT = 48, 56
ENTRY_FIXED = 48
FIELDS = ("MESSAGE", "SYSLOG_IDENTIFIER", "_COMM")


class JournalError(ValueError):
    pass


def _value(flags: int, raw: bytes) -> bytes | None:
    if flags & ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if flags & XZ:
        return lzma.decompress(raw)
    return None if flags & 2 else raw


def entries(file: BinaryIO) -> Iterator[tuple[int, dict[str, str]]]:
    """(microseconds since the epoch, fields) of each entry, as a stream; a torn end ends it."""
    head = file.read(HEADER_MIN)
    if len(head) < HEADER_MIN or head[:8] != SIGNATURE:
        raise JournalError("not a journal file")
    compact = bool(struct.unpack_from("<I", head, 12)[0] & COMPACT)
    header, arena = struct.unpack_from("<QQ", head, 88)
    if header < HEADER_MIN:
        raise JournalError("header size is too small")
    file.read(header - HEADER_MIN)
    at, end = header, header + arena
    held: dict[int, tuple[str, str]] = {}
    item, step = ("<I", 4) if compact else ("<Q", 16)
    while at < end:
        own = file.read(16)
        if len(own) < 16:
            return
        kind, flags, size = own[0], own[1], struct.unpack_from("<Q", own, 8)[0]
        if size < 16:
            return
        body = file.read(size - 16)
        if len(body) < size - 16:
            return
        if kind == DATA:
            raw = _value(flags, body[DATA_FIXED_COMPACT if compact else DATA_FIXED :])
            name, is_field, value = (raw or b"").partition(b"=")
            if is_field and name.decode(errors="replace") in FIELDS:
                held[at] = (name.decode(), value.decode(errors="replace"))
        elif kind == ENTRY:
            when = struct.unpack_from("<Q", body, 8)[0]
            refs = (struct.unpack_from(item, body, k)[0] for k in range(ENTRY_FIXED, len(body) - step + 1, step))
            yield when, dict(held[r] for r in refs if r in held)
        file.read(-size % 8)
        at += size + -size % 8


def stamp(micros: int) -> str:
    when = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)
    return f"{when:%Y-%m-%d %H:%M:%S},{when.microsecond // 1000:03d}"


def lines(file: BinaryIO) -> Iterator[tuple[int, str]]:
    """(number, line): ``time - program: message``; further lines of a message are indented by as much."""
    n = 0
    for when, fields in entries(file):
        program = fields.get("SYSLOG_IDENTIFIER") or fields.get("_COMM")
        if "MESSAGE" not in fields or program is None:
            n += 1
            continue
        head = f"{stamp(when)} - {program}: "
        for k, part in enumerate(fields["MESSAGE"].rstrip("\n").split("\n")):
            n += 1
            yield n, (" " * len(head.encode()) if k else head) + part

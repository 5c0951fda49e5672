"""Vectorised word and hash kernels that the operators of this subpackage share.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; this equals the
regular expression ``[^\\x20\\x09-\\x0D]+`` on the decoded text, because UTF-8 never
uses those bytes inside a longer character.  All hashes are unsigned 64-bit and
depend on the bytes alone: equal on every executor, in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C13
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_STEP_INV = pow(_STEP, -1, 1 << 64)
_OTHER_STEP = 0xC2B2AE3D27D4EB4F

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Everything in ASCII but letters and digits: words then ignore punctuation.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift-multiply, twice)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(29)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int, inverse: int):
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            self.up, self.down = (self._table(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out = np.ones(size, dtype=np.uint64)
        filled = 1
        while filled < size:
            out[filled : 2 * filled] = out[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        return out


_byte_powers = _Powers(_BASE, _BASE_INV)
_word_powers = _Powers(_STEP, _STEP_INV)
_other_powers = _Powers(_OTHER_STEP, pow(_OTHER_STEP, -1, 1 << 64))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each data[start:end], from its bytes."""
    n = len(data)
    up, _ = _byte_powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up, out=total[1:])
    _, down = _byte_powers(n + 1)
    return mix((total[end] - total[start]) * down[start])


class Words:
    """The words of a few whole texts laid end to end.

    ``start``/``end`` are byte positions in ``data``; words ``first[d]:first[d + 1]``
    belong to text ``d``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold_case: bool = False, breaks: np.ndarray = IS_SPACE):
        self.data = LOWER[data] if fold_case else data
        self.offsets = offsets
        n = len(data)
        inside = np.zeros(n + 1, dtype=bool)
        np.logical_not(breaks[data], out=inside[:n])
        begins = inside[:n].copy()
        begins[1:] &= ~inside[: n - 1] if n else begins[1:]
        ends = inside[:n] & ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]  # two texts that touch without a space
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word, from its bytes."""
        return byte_hashes(self.data, self.start, self.end)

    def text_of(self, i: int, j: int) -> bytes:
        """Words i to j (exclusive) of one text, joined by one space."""
        raw = self.data[self.start[i] : self.end[j - 1]].tobytes() if j > i else b""
        return b" ".join(raw.split())


def window_hashes(values: np.ndarray, width: int, other: bool = False) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values, in order; len(values) - width + 1 of them.  other: to another base."""
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = (_other_powers if other else _word_powers)(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1])


def text_slices(column: pa.Array, most_bytes: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``most_bytes``: (row, rows, bytes, offsets).

    A null text counts as empty.  A text is never cut: one longer than the bound comes alone.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1
        stop = min(len(column), max(row + 1, stop))
        own = offsets[row : stop + 1]
        yield row, stop - row, data[own[0] : own[-1]], own - own[0]
        row = stop

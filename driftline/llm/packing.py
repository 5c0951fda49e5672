"""Sequence packing by non-negative least squares over the length histogram.

Texts are cut at multiples of the window; a full piece is a sequence of its own.  The rests are
rounded to ``bins`` lengths.  All combinations of up to ``depth`` binned lengths that fill the window
are enumerated once; repeat counts x >= 0 are solved so that A x meets the histogram of a block of
pieces (Lawson-Hanson), rounded down, and dealt the pieces.  As lengths were rounded, a sequence may
run over: its last piece is cut and the rest becomes a residual.  Residuals, and pieces that
rounding left over, are packed greedily: the longest that fits first, then cut to fit.

A block holds at most ``block`` pieces or ``block_tokens`` tokens, so a task's memory is bounded; what
does not fill a sequence moves on to the task's next block, so that a task leaves one short
sequence at most.  Nothing is shuffled.  Sequence ids are (partition << 33) + number: the same in
every attempt of a task.
"""

from __future__ import annotations

import itertools
import os
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, trim
from .textops import IS_SPACE, LOWER, Words, byte_hashes, text_slices

WINDOW = 4096
BINS = 16
DEPTH = 8
BLOCK, BLOCK_TOKENS = 8192, 4_000_000
END = 2
#: A gap or an overrun of fewer tokens is not worth a cut.
SMALL = 16
CACHED_STEMS = 300_000
#: Bytes of text whose words are looked up at once, and of the longest word that is kept.
SLICE, LONGEST = 1 << 18, 64
#: Ids after which a task gives freed memory back.
TRIM = 1 << 20


_CLOSING = np.isin(np.arange(256), list(b".,!?;:"))
_LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])


def _symbols() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character: itself, or the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = itertools.count(256)
    return {b: chr(b) if b in printable else chr(next(free)) for b in range(256)}


_SYMBOL = _symbols()


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start[0], start[0] + 1 .. (length[0] of them), then those of the next run, and so on."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


class _Table:
    """Byte strings and their values laid end to end, found by hash in open slots: about 50 bytes a word.

    An entry counts only if its bytes are those asked for; a hash alone decides nothing.
    """

    def __init__(self, most: int):
        self.n, self.mask = 0, (1 << (2 * most).bit_length()) - 1
        self.slots = np.full(self.mask + 1, -1, dtype=np.int32)
        self.hash = np.zeros(most, dtype=np.uint64)
        self.ends = [np.zeros(most + 1, dtype=np.int32) for _ in range(2)]  # of keys and of values
        self.data = [np.zeros(1 << 16, dtype=np.uint8) for _ in range(2)]

    def __len__(self) -> int:
        return self.n

    def places(self, which: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the entries' keys (0) or values (1)."""
        start = self.ends[which][entries].astype(np.int64)
        return start, self.ends[which][entries + 1] - start

    def find(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The entry of each key data[start : start + length] (none is empty), or -1."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        at, left = (hashes & np.uint64(self.mask)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            entry = self.slots[at[left]]
            left, entry = left[entry >= 0], entry[entry >= 0]
            same = self.hash[entry] == hashes[left]
            out[left[same]] = entry[same]
            left = left[~same]
            at[left] = (at[left] + 1) & self.mask
        for fits in (lambda k, begin, n: n == length[k], lambda k, begin, n: ~np.logical_or.reduceat(self.data[0][_runs(begin, n)] != data[_runs(start[k], n)], np.cumsum(n) - n)):
            k = np.flatnonzero(out >= 0)
            if len(k):
                out[k[~fits(k, *self.places(0, out[k]))]] = -1
        return out

    def add(self, hashes: np.ndarray, *parts: tuple[np.ndarray, np.ndarray]) -> None:
        """New entries; parts: keys and values, each as (bytes end to end, lengths)."""
        own = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        for which, (data, length) in enumerate(parts):
            ends, used = self.ends[which], int(self.ends[which][self.n])
            ends[self.n + 1 : self.n + 1 + len(own)] = used + np.cumsum(length)
            if used + len(data) > len(self.data[which]):
                room = np.zeros(max(used + len(data), len(self.data[which]) * 3 // 2), dtype=np.uint8)
                room[:used] = self.data[which][:used]
                self.data[which] = room
            self.data[which][used : used + len(data)] = data
        self.hash[self.n : self.n + len(own)] = hashes
        self.n += len(own)
        at, left = (hashes & np.uint64(self.mask)).astype(np.int64), np.arange(len(own))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = own[free]
            left = left[self.slots[at[left]] != own[left]]
            at[left] = (at[left] + 1) & self.mask


class _Known:
    """Values of words, worked out when first asked for, in two generations of at most ``most`` words.

    When the young one is full it becomes the old one; a word of the old one that is asked for again
    moves on, so frequent words stay and rare ones go.  Words of over ``LONGEST`` bytes are not kept.
    """

    def __init__(self, most: int, find):
        self.most, self.find = most, find
        self.young, self.old = _Table(most), _Table(1)

    def __len__(self) -> int:
        return len(self.young)

    def __getitem__(self, word: bytes) -> bytes:
        return self.values(np.frombuffer(word, dtype=np.uint8), np.array([0, len(word)]))[0].tobytes()

    def values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of some distinct words, end to end, and their lengths."""
        start, length = offsets[:-1], np.diff(offsets)
        hashes = byte_hashes(data, start, offsets[1:])
        young = self.young.find(hashes, data, start, length)
        old = np.full(len(young), -1, dtype=np.int64)
        rest = np.flatnonzero(young < 0)
        old[rest] = self.old.find(hashes[rest], data, start[rest], length[rest])
        new = np.flatnonzero((young < 0) & (old < 0))
        raw = data.tobytes()
        found = [self.find(raw[a:b]) for a, b in zip(start[new].tolist(), offsets[new + 1].tolist(), strict=True)]
        sizes = np.zeros(len(young), dtype=np.int64)
        sizes[new] = [len(x) for x in found]
        kept = [(k, table.data[1], *table.places(1, entry[k])) for table, entry in ((self.young, young), (self.old, old)) if len(k := np.flatnonzero(entry >= 0))]
        for k, _, _, n in kept:
            sizes[k] = n
        begin = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), dtype=np.uint8)
        out[_runs(begin[new], sizes[new])] = np.frombuffer(b"".join(found), dtype=np.uint8)
        for k, values, at, n in kept:
            out[_runs(begin[k], n)] = values[_runs(at, n)]
        fresh = rest[length[rest] <= LONGEST][: self.most]
        if len(self.young) + len(fresh) > self.most:
            self.old, self.young = self.young, _Table(self.most)
        self.young.add(hashes[fresh], (data[_runs(start[fresh], length[fresh])], length[fresh]), (out[_runs(begin[fresh], sizes[fresh])], sizes[fresh]))
        return out, sizes


def _plain(text: str) -> bool:
    """Whether a word is one run of letters, before and after lower-casing, that normalising leaves alone."""
    if text.isascii():
        return text.isalpha()
    # a letter whose lower case is two code points (a dotted capital I) is no single run afterwards
    return text.isalpha() and max(text) < "\u0180" and len(low := text.lower()) == len(text) and low.isalpha() and unicodedata.is_normalized("NFC", text)


def _parts(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Text cut after white space into parts of at most ``most`` bytes; a longer word comes whole."""
    at = 0
    while at < len(data):
        stop = min(at + most, len(data))
        if stop < len(data):
            gaps = at + np.flatnonzero(IS_SPACE[data[at:stop]])[-1:]
            while not len(gaps) and stop < len(data):
                gaps = stop + np.flatnonzero(IS_SPACE[data[stop : stop + most]])[:1]
                stop = min(stop + most, len(data))
            stop = int(gaps[0]) + 1 if len(gaps) else stop
        yield data[at:stop]
        at = stop


class Encoder:
    """Little-endian unsigned 32-bit ids of whole texts, white-space separated word by word.

    Only for tokenizers that lower-case, drop white space and never join across it or between a letter
    and following punctuation; an encoding is then the concatenation of its words' encodings, and
    most words have been seen before.  Bounded memory: words are taken ``SLICE`` bytes of text at a time and
    kept as bytes in arrays, about 30 MB at the most.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        plain = tokenizer.model.tokenize

        def full(text: str) -> list[int]:
            return tokenizer.encode(text, add_special_tokens=False).ids

        def letters(text: str) -> list[int]:
            """A run of Latin letters needs no rules for splitting: straight to the merges, as byte-level symbols."""
            return [t.id for t in plain(text.lower().encode().decode("latin-1").translate(_SYMBOL))]

        try:
            direct = all(full(w) == letters(w) for w in ("the", "Zeitung", "straße", "señor", "Été", "ž", "xqzjkw"))
        except Exception:  # another kind of model
            direct = False

        def stem(word: bytes) -> bytes:
            text = word.decode()
            ids = (letters if direct and _plain(text) else full)(text)
            return struct.pack(f"<{len(ids)}I", *ids)

        self.stems = _Known(CACHED_STEMS, stem)

    def __call__(self, text: bytes) -> bytes:
        return next(self.texts(pa.array([text], pa.binary()))).tobytes()

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column; a null text has none."""
        for _, n, data, offsets in text_slices(column, SLICE):
            if len(data) > SLICE:  # one text alone
                yield np.concatenate([self._slice(x, np.array([0, len(x)]))[0] for x in _parts(data, SLICE)])
            else:
                ids, ends = self._slice(data, offsets)
                yield from (ids[ends[k] : ends[k + 1]] for k in range(n))

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, end to end, and where each text's begin and end."""
        words = Words(data, offsets)
        if not len(words):
            return np.zeros(0, dtype="<u4"), np.zeros(len(offsets), dtype=np.int64)
        # a word's closing punctuation is a part of its own; only after an ASCII letter is the cut surely a token's end
        cut = np.maximum.accumulate(np.where(_CLOSING[data], -1, np.arange(len(data))))[words.end - 1] + 1
        cut = np.where((cut > words.start) & _LETTER[data[cut - 1]], cut, words.end)
        start, end = np.stack([words.start, cut], axis=1).ravel(), np.stack([cut, words.end], axis=1).ravel()
        first = np.concatenate([[0], np.cumsum(end > start)])[2 * words.first]
        start, end = start[end > start], end[end > start]
        length = end - start
        others = np.concatenate([[0], np.cumsum(~_LETTER[data])])
        at = _runs(start, length)
        flat = np.where(np.repeat(others[start] == others[end], length), LOWER[data[at]], data[at])
        ends = np.concatenate([[0], np.cumsum(length)])
        parts = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).dictionary_encode()
        distinct, which = parts.dictionary, parts.indices.to_numpy()
        buffers = distinct.buffers()
        values, sizes = self.stems.values(np.frombuffer(buffers[2], dtype=np.uint8), np.frombuffer(buffers[1], dtype=np.int64)[: len(distinct) + 1])
        values, sizes = values.view("<u4"), sizes // 4
        begin, own = (np.cumsum(sizes) - sizes)[which], sizes[which]
        return values[_runs(begin, own)], np.concatenate([[0], np.cumsum(own)])[first]


_encoders: dict[str, Encoder] = keeps("packing")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def strategies(bins: int, depth: int) -> np.ndarray:
    """Each row: how often each binned length 1..bins occurs in one way to fill the window."""
    out = []

    def extend(rest: int, most: int, parts: list[int]) -> None:
        if not rest:
            out.append(np.bincount(parts, minlength=bins + 1)[1:])
        elif len(parts) < depth:
            for p in range(min(rest, most), 0, -1):
                extend(rest - p, p, [*parts, p])

    extend(bins, bins, [])
    return np.array(out)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """argmin |a x - b| over x >= 0, by an active set of positive coordinates."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    slope = a.T @ b
    tiny = 1e-9 * max(1.0, float(np.abs(slope).max(initial=0)))
    for _ in range(rounds):
        if free.all() or slope[~free].max() <= tiny:
            break
        free[np.where(free, -np.inf, slope).argmax()] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (z <= tiny)
            if not bad.any():
                break
            step = float(np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300)))
            x += step * (z - x)
            free &= x > tiny
            x[~free] = 0
            if not free.any():
                z = x
                break
        x = z
        slope = a.T @ (b - a @ x)
    return x


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Packer:
    def __init__(self, window: int, bins: int, depth: int):
        self.window, self.bins = window, bins
        self.ways = strategies(bins, depth)

    def pack(self, pieces: list[Piece], last: bool) -> tuple[list[list[Piece]], list[Piece]]:
        """Full (or nearly full) sequences, and the pieces that fill none; with last, these are sequences too."""
        width = self.window / self.bins
        by_bin: list[list[Piece]] = [[] for _ in range(self.bins)]
        for p in pieces:
            by_bin[min(self.bins, max(1, round(len(p.ids) / width))) - 1].append(p)
        have = np.array([len(x) for x in by_bin])
        repeats = np.floor(nnls(self.ways.T.astype(float), have.astype(float)) + 1e-9).astype(int)
        sequences, residual = [], []
        for way, n in zip(self.ways, repeats, strict=True):
            for _ in range(int(min(n, *(have[way > 0] // way[way > 0])))):
                have = have - way
                own = [by_bin[b].pop() for b in np.repeat(np.arange(self.bins), way)]
                own.sort(key=lambda p: -len(p.ids))
                room, kept = self.window, []
                for p in own:
                    if len(p.ids) > room:
                        p, rest = p.cut(room)
                        residual.append(rest)
                    if len(p.ids):
                        kept.append(p)
                        room -= len(p.ids)
                sequences.append((room, kept))
        residual += itertools.chain.from_iterable(by_bin)
        residual.sort(key=lambda p: len(p.ids))
        done = []
        for room, kept in sorted(sequences, key=lambda s: -s[0]):
            done.append(kept + self._fill(room, residual))
        while sum(len(p.ids) for p in residual) >= self.window:
            done.append(self._fill(self.window, residual))
        if last and residual:
            done.append(residual)
            residual = []
        return done, residual

    def _fill(self, room: int, residual: list[Piece]) -> list[Piece]:
        """Take from residual (sorted by length) what fills the room: the longest that fit, then a cut one."""
        taken = []
        while residual and room >= SMALL:
            lo, hi = 0, len(residual)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if len(residual[mid].ids) <= room else (lo, mid)
            if lo:
                p = residual.pop(lo - 1)
            else:
                p, rest = residual.pop(0).cut(room)
                at = next((k for k, x in enumerate(residual) if len(x.ids) >= len(rest.ids)), len(residual))
                residual.insert(at, rest)
            taken.append(p)
            room -= len(p.ids)
        return taken


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END,
    window: int = WINDOW,
    bins: int = BINS,
    depth: int = DEPTH,
    block: int = BLOCK,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids binary, doc_tokens, sequence_id, offset).

    ``ids`` are little-endian unsigned 32-bit; a text's ids end with end_id, so a null or empty text has one
    piece of one id.  Every id lies in exactly one piece.  Repeated rows are packed each; further
    columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer_path), Packer(window, bins, depth)
        base, number = TaskContext.get().partitionId() << 33, 0
        end = np.array([end_id], dtype="<u4")
        held: list[Piece] = []
        tokens = since = 0

        def rows(sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for some in itertools.batched(sequences, 64):
                out: list[list] = [[], [], [], [], [], []]
                for own in some:
                    offset = 0
                    for p in own:
                        for to, x in zip(out, (p.doc, p.start, len(p.ids), p.total, base + number, offset), strict=True):
                            to.append(x)
                        offset += len(p.ids)
                    number += 1
                doc, start, length, total, sequence, offset = (pa.array(x, pa.int64()) for x in out)
                ends = np.concatenate([[0], np.cumsum(length.to_numpy())]).astype(np.int32) * 4
                ids = np.concatenate([p.ids for own in some for p in own])
                ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.record_batch([doc, start, length, ids, total, sequence, offset], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            full: list[list[Piece]] = []
            for doc, own in zip(batch.column(0), encode.texts(batch.column(1)), strict=True):
                ids = np.concatenate([own, end])
                since += len(ids)
                if since >= TRIM:
                    trim()
                    since = 0
                whole = len(ids) // window * window
                for s in range(0, whole, window):
                    full.append([Piece(doc.as_py(), s, ids[s : s + window], len(ids))])
                if whole < len(ids):
                    held.append(Piece(doc.as_py(), whole, ids[whole:], len(ids)))
                    tokens += len(ids) - whole
                if len(full) >= 64:
                    yield from rows(full)
                    full = []
                if len(held) >= block or tokens >= block_tokens:
                    done, held = packer.pack(held, last=False)
                    yield from rows(done)
                    tokens = sum(len(p.ids) for p in held)
            yield from rows(full)
        if held:
            done, held = packer.pack(held, last=True)
            yield from rows(done)
            del done
        trim()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digests(pieces: DataFrame) -> DataFrame:
    """The operator's rows with the checksum of the ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

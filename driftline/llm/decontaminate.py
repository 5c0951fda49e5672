"""Benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters and digits and of all other characters beyond ASCII, lower case for A-Z.
A document and a benchmark item that share a run of ``seed`` tokens are a candidate pair.  Tiling
then marks, again and again, the longest match of tokens that no earlier tile has taken on either
side, down to ``seed`` tokens; windows of the current length are compared by running Karp-Rabin
hashes and extended token by token.  The share of the item's tokens under tiles is its coverage,
whatever their order in the document; from ``least`` on the document is contaminated.

Benchmarks up to ``MOST_CHARS`` characters (checked) are sent to the executors and documents are read
once.  Larger ones are joined on seed hashes, an equi-join that Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lighten, trim
from .textops import NOT_ALNUM, Words, text_slices, window_hashes

SEED = 5
LEAST = 0.5
MOST_CHARS = 8_000_000
LONG = 24


def token_lists(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, token hashes) of each text."""
    for row, n, data, offsets in text_slices(column):
        words = Words(data, offsets, fold_case=True, breaks=NOT_ALNUM)
        values = words.hashes()
        for i in range(n):
            yield row + i, values[words.first[i] : words.first[i + 1]]


def _free_windows(tokens: np.ndarray, taken: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the windows without a taken token."""
    h = window_hashes(tokens, width)
    if not len(h):
        return h, np.zeros(0, np.int64)
    used = np.concatenate([[0], np.cumsum(taken)])
    at = np.flatnonzero(used[width:] == used[:-width])
    return h[at], at


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length), longest first at each search length."""
    item_taken, doc_taken = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    found: list[tuple[int, int, int]] = []
    width = max(least, min(LONG, len(item), len(doc)))
    while True:
        ih, ia = _free_windows(item, item_taken, width)
        dh, da = _free_windows(doc, doc_taken, width)
        order = np.argsort(ih, kind="stable")
        lo, hi = np.searchsorted(ih[order], dh, "left"), np.searchsorted(ih[order], dh, "right")
        matches, longest, reach = [], 0, {}
        for k in np.flatnonzero(hi > lo):
            for p in ia[order[lo[k] : hi[k]]]:
                d = int(da[k])
                p = int(p)
                if reach.get(d - p, -1) >= d:  # inside a match on this diagonal
                    continue
                n = 0
                while p + n < len(item) and d + n < len(doc) and item[p + n] == doc[d + n] and not item_taken[p + n] and not doc_taken[d + n]:
                    n += 1
                if n >= width:
                    matches.append((n, p, d))
                    longest = max(longest, n)
                    reach[d - p] = d + n - width
        if longest > 2 * width:
            width = longest
            continue
        for n, p, d in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not item_taken[p : p + n].any() and not doc_taken[d : d + n].any():
                item_taken[p : p + n] = doc_taken[d : d + n] = True
                found.append((p, d, n))
        if width == least:
            # a match cut by an earlier tile may have left a free part of the least length
            if not matches or all(item_taken[p] and doc_taken[d] for _, p, d in matches) and not _shared(item, item_taken, doc, doc_taken, least):
                return found
        width = max(least, width // 2) if width > least else least


def _shared(item: np.ndarray, item_taken: np.ndarray, doc: np.ndarray, doc_taken: np.ndarray, width: int) -> bool:
    return bool(np.isin(_free_windows(item, item_taken, width)[0], _free_windows(doc, doc_taken, width)[0]).any())


class Seeds:
    """The seeds of some items: sorted hashes with item number and place."""

    def __init__(self, items: list[np.ndarray], seed: int):
        self.items, self.seed = items, seed
        grams = [window_hashes(t, min(seed, len(t))) if len(t) else t for t in items]
        self.short = {n for n in map(len, items) if 0 < n < seed}
        self.hash = np.concatenate([*grams, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        self.at = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.at = self.hash[order], self.item[order], self.at[order]

    def candidates(self, doc: np.ndarray, least: float) -> list[int]:
        """Items whose shared seeds alone could cover the share."""
        if not len(self.hash):
            return []
        hit = []
        for width in {self.seed, *self.short}:
            h = window_hashes(doc, width)
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            hit.append(h[self.hash[at] == h])
        mine = np.isin(self.hash, np.unique(np.concatenate(hit)))
        out = []
        for i in np.unique(self.item[mine]):
            n = len(self.items[i])
            cover = np.zeros(n, bool)
            for p in self.at[mine & (self.item == i)]:
                cover[p : p + self.seed] = True
            if cover.sum() >= least * n:
                out.append(int(i))
        return out


def _judge(item: np.ndarray, doc: np.ndarray, seed: int, least: float) -> tuple[int, list[tuple[int, int, int]]] | None:
    found = tiles(item, doc, min(seed, len(item)))
    covered = sum(n for _, _, n in found)
    return (covered, found) if covered >= least * len(item) else None


_RESULT = "n_tokens long, n_covered long, coverage double, tiles array<struct<item_start:int,doc_start:int,length:int>>"
_TILES = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))


def _rows(found: list[tuple]) -> pa.RecordBatch:
    ids, items, n, covered, tiled = zip(*found, strict=True)
    spans = [[dict(zip(("item_start", "doc_start", "length"), t, strict=True)) for t in sorted(x)] for x in tiled]
    return pa.record_batch(
        [pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(n, pa.int64()), pa.array(covered, pa.int64()), pa.array([c / t for c, t in zip(covered, n, strict=True)], pa.float64()), pa.array(spans, _TILES)],
        names=["doc_id", "item_id", "n_tokens", "n_covered", "coverage", "tiles"],
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    least: float = LEAST,
    most_chars: int = MOST_CHARS,
) -> DataFrame:
    """One row for each contaminated pair: (doc_id, item_id, n_tokens, n_covered, coverage, tiles).

    benchmark has item_id and text.  Null or token-less texts, of documents or items, match nothing;
    an item shorter than a seed matches as a whole.  Repeated rows each give their own rows (a joined
    benchmark: count once); a null id stays null; further columns are ignored; an empty table on either side
    gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    if (benchmark.agg(F.sum(F.length("text") + 16)).first()[0] or 0) <= most_chars:
        table = benchmark.toArrow()
        names = table["item_id"].to_pylist()
        seeds = Seeds([t for _, t in token_lists(table["text"].combine_chunks())] if len(names) else [], seed)
        sent = docs.sparkSession.sparkContext.broadcast((names, seeds))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lighten("decontaminate")
            names, seeds = sent.value
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), []
                for row, doc in token_lists(batch.column(1)):
                    for i in seeds.candidates(doc, least) if len(doc) else ():
                        if got := _judge(seeds.items[i], doc, seed, least):
                            found.append((ids[row], names[i], len(seeds.items[i]), *got))
                if found:
                    yield _rows(found)
            trim()

        return docs.mapInArrow(scan, f"doc_id long, item_id long, {_RESULT}")
    return _joined(docs, benchmark, seed, least)


def _joined(docs: DataFrame, benchmark: DataFrame, seed: int, least: float) -> DataFrame:
    """The same where the benchmark is too large to send: documents and items meet on seed hashes.

    A row without an id cannot be joined and gives no pair here; rows of one id and text count once.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    docs = docs.where("doc_id is not null").distinct()
    items = scratch.put(benchmark.where("item_id is not null").distinct(), "items")

    def seeds_of(df: DataFrame, key: str, widths: list[int] | None) -> DataFrame:
        """(key, seed, width, n): the distinct seeds; of an item the longest that it has, of a document those of all widths."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lighten("decontaminate")
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for row, tokens in token_lists(batch.column(1)):
                    for width in [min(seed, len(tokens))] if widths is None else widths:
                        if 0 < width <= len(tokens):
                            h = np.unique(window_hashes(tokens, width))
                            yield pa.record_batch([pa.array(np.full(len(h), ids[row])), pa.array(h.view(np.int64)), pa.array(np.full(len(h), width, np.int32)), pa.array(np.full(len(h), len(tokens), np.int32))], names=[key, "seed", "width", "n"])

        return df.select(key, "text").mapInArrow(run, f"{key} long, seed long, width int, n int")

    mine = scratch.put(seeds_of(items, "item_id", None), "item-seeds")
    widths = [r.width for r in mine.select("width").distinct().collect()]  # at most ``seed`` of them
    theirs = scratch.put(seeds_of(docs, "doc_id", widths).select("doc_id", "seed", "width").join(mine.select("seed", "width").distinct(), ["seed", "width"], "left_semi"), "doc-seeds")
    # a seed covers ``width`` tokens wherever the item has it; so many different ones must be shared at least
    repeats = mine.groupBy("item_id").agg(F.count("*").alias("distinct"), F.first("n").alias("n"), F.first("width").alias("width"))
    shared = theirs.join(mine.select("item_id", "seed", "width"), ["seed", "width"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("c"))
    windows = F.col("n") - F.col("width") + 1
    needed = (F.col("c") + windows - F.col("distinct")) * F.col("width") >= F.lit(least) * F.col("n")
    pairs = scratch.put(shared.join(repeats, "item_id").where(needed).select("doc_id", "item_id"), "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten("decontaminate")
        for batch in batches:
            found = []
            items = dict(token_lists(batch.column(2)))
            for row, doc in token_lists(batch.column(3)):
                if len(items[row]) and (got := _judge(items[row], doc, seed, least)):
                    found.append((batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), len(items[row]), *got))
            if found:
                yield _rows(found)

    both = pairs.join(items.withColumnRenamed("text", "item"), "item_id").join(docs, "doc_id")
    return both.select("doc_id", "item_id", "item", "text").mapInArrow(run, f"doc_id long, item_id long, {_RESULT}")

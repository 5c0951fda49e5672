"""Substring dedup over a log-structured fingerprint index.

A window is ``width`` consecutive words of one text.  Each window is represented by its minimiser:
the inner run of ``gram`` words with the smallest hash.  Equal windows have the same minimiser at the
same place, so a repeated window always shows as a repeated fingerprint, while about one position in
twelve is indexed.  Each indexed position also carries the hash of its context (all words that any
window with this minimiser can cover).

The index is log-structured: immutable runs (fp, n), each bucketed and sorted by fingerprint, one row a
fingerprint, so that a hot one cannot swell a bucket.  A batch of new texts becomes one run, which is
merge-joined with each stored run (equal buckets, no shuffle): what some run has, or what stands twice in the
batch, is a hit.  When there are more than ``most_runs`` runs, they are merged two by two, again bucket by
bucket.  Beside the runs the index keeps the places (row, at, fp, ctx) of each batch.  Hits are verified:

* equal contexts (128 bits with the fingerprint) prove all windows of the position repeated;
* where one fingerprint has several contexts, one position of each context hands out its windows
  (two 64-bit hashes, to different bases, of exactly ``width`` words), which are counted over all texts.

Only such positions cost a row per window.  All joins are equi-joins on hashes, which Spark can split where
a key is hot; counts of hot fingerprints combine before the shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, restrict
from .textops import Words, _word_powers, mix, text_slices, window_hashes

WIDTH = 35
GRAM = 10
MOST_RUNS = 2
BATCHES = 4
#: Rows of a run in one bucket, about.
BUCKET_ROWS = 2_000_000
#: Of the second hash of a window.
_OTHER_BASE = 0x2545F4914F6CDD1D


def _minimisers(values: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: (position, fingerprint, context hash, first window, last window) of each minimiser, by position.

    The windows of a minimiser are the consecutive starts first..last.
    """
    grams = window_hashes(values, gram)
    span = width - gram + 1
    lowest = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(values) - width + 1)
    # leftmost minimum: positions never fall as the window moves on
    new = np.flatnonzero(np.diff(lowest, prepend=-1))
    at, last = lowest[new], np.append(new[1:], len(lowest)) - 1
    lo, hi = np.maximum(at + gram - width, 0), np.minimum(at + width, len(values))
    n = len(values)
    up, down = _word_powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(values) * up[:n], out=total[1:])
    shape = (at - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - at).astype(np.uint64)
    context = mix(mix((total[hi] - total[lo]) * down[lo]) + shape)
    return at, grams[at], context, new, last


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, Words, int]]:
    """(row, word hashes, words, index in words) of each text of a batch."""
    for row, n, data, offsets in text_slices(batch.column(column)):
        words = Words(data, offsets)
        values = words.hashes()
        for i in range(n):
            yield row + i, values[words.first[i] : words.first[i + 1]], words, i


def fingerprints(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """(row, at, fp, ctx) of every minimiser of every whole text of rows (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            own, ats, fps, ctxs = [], [], [], []
            for row, values, _, _ in _texts(batch, 1):
                if len(values) >= width:
                    at, fp, ctx, _, _ = _minimisers(values, width, gram)
                    own.append(np.full(len(at), keys[row]))
                    ats.append(at)
                    fps.append(fp)
                    ctxs.append(ctx)
            if own:
                yield pa.record_batch([pa.array(np.concatenate(own)), pa.array(np.concatenate(ats).astype(np.int32)), pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(ctxs).view(np.int64))], names=["row", "at", "fp", "ctx"])

    return rows.select("row", "text").mapInArrow(run, "row long, at int, fp long, ctx long")


class FingerprintIndex:
    """Immutable runs (fp, n), bucketed and sorted by fp: how many places of the texts so far have it."""

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int, most_runs: int = MOST_RUNS):
        self.spark, self.scratch, self.buckets, self.most_runs = spark, scratch, buckets, most_runs
        self.runs: list[str] = []

    def _run(self, counted: DataFrame) -> str:
        name = f"driftline_run_{uuid.uuid4().hex}"
        dealt = counted.repartition(self.buckets, "fp")
        dealt.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        return name

    def _drop(self, *runs: str) -> None:
        for name in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch.delete(f"{self.scratch.root}/{name}")

    def add(self, found: DataFrame) -> DataFrame:
        """Make a batch of places one run; (fp) of those that an earlier run has or that stand twice in the batch."""
        mine = self._run(found.groupBy("fp").agg(F.count("*").alias("n")))
        new = self.spark.table(mine)
        hits = new.where("n > 1").select("fp")
        for run in self.runs:
            hits = hits.union(new.join(self.spark.table(run).select("fp").hint("merge"), "fp", "left_semi").select("fp"))
        hits = self.scratch.put(hits, "hits")
        self.runs.append(mine)
        if len(self.runs) > self.most_runs:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merge all runs into one, two by two in the order of their fingerprints."""
        while len(self.runs) > 1:
            a, b = (self.spark.table(x).select("fp", F.col("n").alias(k)) for x, k in zip(self.runs[-2:], ("a", "b"), strict=True))
            both = a.join(b.hint("merge"), "fp", "full_outer").select("fp", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))
            merged = self._run(both)
            self._drop(*self.runs[-2:])
            self.runs[-2:] = [merged]

    def close(self) -> None:
        self._drop(*self.runs)
        self.runs = []


def _windows(rows: DataFrame, wanted: DataFrame, width: int, gram: int) -> DataFrame:
    """(row, w, h1, h2): the windows of the wanted (row, at) minimisers."""
    places = wanted.groupBy("row").agg(F.collect_set("at").alias("ats"))
    texts = restrict(rows.select("row", "text"), places.select("row"), "row").join(places, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(0).to_numpy(), batch.column(2)
            for row, values, _, _ in _texts(batch, 1):
                at, _, _, first, last = _minimisers(values, width, gram)
                take = np.isin(at, np.asarray(lists[row].values))
                starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[take], last[take], strict=True)])
                h1, h2 = window_hashes(values, width)[starts], window_hashes(mix(values ^ np.uint64(_OTHER_BASE)), width, other=True)[starts]
                yield pa.record_batch([pa.array(np.full(len(starts), keys[row])), pa.array(starts.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["row", "w", "h1", "h2"])

    return texts.select("row", "text", "ats").mapInArrow(run, "row long, w int, h1 long, h2 long")


def _cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of n words that lie in one of the intervals [start, end)."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    gram: int = GRAM,
    batches: int = BATCHES,
    most_runs: int = MOST_RUNS,
) -> DataFrame:
    """One row for each document: (id_col, n_words, n_removed, kept_text).

    A word goes if a window of ``width`` words that covers it also starts anywhere else, in the same
    or another text; windows are judged on the input.  ``kept_text`` joins the other words by one
    space.  Null text: no words.  Texts shorter than a window keep all.  Repeated rows are documents of
    their own, and so copies of each other; ids may be null or repeat.  Further columns are ignored;
    an empty table gives an empty one.  The texts are indexed in ``batches`` batches, whose number does
    not change the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = scratch.put(fingerprints(rows, width, gram), "places")
    index = FingerprintIndex(spark, scratch, max(8, -(-found.count() // BUCKET_ROWS)), most_runs)
    hits = [index.add(found.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == b)) for b in range(batches)]
    every = hits[0]
    for more in hits[1:]:
        every = every.union(more)
    every = scratch.put(every.distinct(), "repeated")
    again = scratch.put(restrict(found, every, "fp"), "again")
    scratch.drop(found, *hits)
    index.close()

    contexts = scratch.put(again.groupBy("fp", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("one")), "contexts")
    several = contexts.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1").select("fp")
    several = scratch.put(several, "several")  # written, so that AQE can split a hot key of the join
    # one place of each context of such a fingerprint hands out its windows
    open_ = scratch.put(contexts.join(several, "fp", "left_semi").select(F.col("one.row").alias("row"), F.col("one.at").alias("at")), "open")
    windows = scratch.put(_windows(rows, open_, width, gram), "windows")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    twice = scratch.put(twice, "twice")
    single = windows.join(twice, ["h1", "h2"], "left_semi").select("row", "w")
    # intervals of words to remove: whole minimisers of repeated contexts, single windows for the rest
    sure = again.join(contexts.where("n > 1").select("fp", "ctx"), ["fp", "ctx"], "left_semi").select("row", F.col("at").alias("x"), F.lit(True).alias("whole"))
    marks = sure.union(single.select("row", "w", F.lit(False)))
    marks = scratch.put(marks.groupBy("row").agg(F.sort_array(F.collect_set(F.when(F.col("whole"), F.col("x")))).alias("whole"), F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("x")))).alias("single")), "marks")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            whole, single = batch.column(2), batch.column(3)
            n_words, n_removed, kept = [], [], []
            for row, values, words, i in _texts(batch, 1):
                n, base = len(values), words.first[i]
                starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                if whole[row].is_valid and len(whole[row]):
                    at, _, _, first, last = _minimisers(values, width, gram)
                    take = np.isin(at, np.asarray(whole[row].values))
                    starts.append(first[take])
                    ends.append(last[take] + width)
                if single[row].is_valid and len(single[row]):
                    s = np.asarray(single[row].values).astype(np.int64)
                    starts.append(s)
                    ends.append(s + width)
                gone = _cover(n, np.concatenate(starts), np.concatenate(ends))
                left = words.text_of(base, base + n).split(b" ") if n else []
                if gone.any():
                    left = [left[k] for k in np.flatnonzero(~gone)]
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(left).decode())
            yield pa.record_batch([batch.column(4), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", "kept_text"])

    return rows.join(marks, "row", "left").select("row", "text", "whole", "single", "id").mapInArrow(run, f"`{id_col}` long, n_words long, n_removed long, kept_text string")


def digests(result: DataFrame) -> DataFrame:
    """The operator's rows with the hash of the kept words instead of the words."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: a text's distinct 5-word shingles are thrown into t bins in rounds.  In round i < t the
i-th hash gives each shingle a bin and a value, and each bin keeps the smallest of i + value; in
round t + j all shingles go to bin j, so that after 2t rounds every bin is filled for certain.
A text leaves as soon as its bins are full, which is after O(1) rounds once it has t log t
shingles.  Bins of two texts agree with the probability of their Jaccard similarity, with
concentration as for independent hashes.

Banding finds candidates, the full shingle sets confirm them.  The defaults (40 bands of 4) miss
a pair at similarity 0.75 with probability 3e-7.

Skew: texts with equal shingle sets are first reduced to one representative (a map-side minimum),
so a group of exact copies costs one row.  In rounds, each text is compared with one pivot only, the one
it shares most buckets with: the smallest text of another component in a bucket.  A first round
over a few bands joins most of a large group, so that later rounds see only what is still apart.
Then all pairs of different components in one bucket are compared, in blocks of bounded size: the
rows outside a bucket's main component against all of its rows, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lighten, restrict, trim, union_find
from .textops import Words, mix, text_slices, window_hashes

SHINGLE = 5
BANDS, ROWS = 40, 4
SIMILAR = 75  # percent
#: A pair whose sketches agree in fewer bins is not verified; at similarity 0.75 this lies 4.4 standard deviations down.
LEAST_AGREEING = 0.6
#: A block of a bucket has about so many rows and so many shingles (4 bytes each) at the most.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
FIRST_BANDS = 8


def shingle_sets(words: Words, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text has its whole sequence as one."""
    values, first = words.hashes(), words.first
    grams = window_hashes(values, width)
    out = []
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(window_hashes(values[a:b], b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t 64-bit bin values for each non-empty set (rows of empty sets stay at the maximum)."""
    full = np.full(len(sets) * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        bins = (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        value = (np.uint64(i) << np.uint64(54)) | (mix(h) >> np.uint64(10))
        np.minimum.at(full, owner * t + bins, value)
        open_ = (full.reshape(-1, t) == np.iinfo(np.uint64).max).any(axis=1)
        keep = open_[owner]
        items, owner = items[keep], owner[keep]
    return full.reshape(-1, t)


def digest(values: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums that name a set."""
    a, b = np.sum(mix(values), dtype=np.uint64), np.sum(mix(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    return tuple(int(x) for x in np.array([a, b], dtype=np.uint64).view(np.int64))


def features(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, fp1, fp2, bands array<long>, sketch binary of the low 16 bits of each bin)."""
    t = bands * rows
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten("near_dup")
        for batch in batches:
            ids = batch.column(0)
            for row, n, data, offsets in text_slices(batch.column(1)):
                sets = shingle_sets(Words(data, offsets, fold_case=True), width)
                bins = sketch(sets, t)
                keys = bins.reshape(n, bands, rows)
                h = np.zeros((n, bands), dtype=np.uint64)
                for r in range(rows):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + keys[:, :, r])
                h = mix(h ^ salt)
                fp = [digest(s) for s in sets]
                low = (bins & np.uint64(0xFFFF)).astype("<u2")
                yield pa.record_batch(
                    [
                        ids.slice(row, n),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([a for a, _ in fp], pa.int64()),
                        pa.array([b for _, b in fp], pa.int64()),
                        pa.array(list(h.view(np.int64)), pa.list_(pa.int64())),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    names=["id", "n_shingles", "fp1", "fp2", "bands", "sketch"],
                )
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary")


def with_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, shingles binary): the sorted distinct 64-bit shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten("near_dup")
        for batch in batches:
            for row, n, data, offsets in text_slices(batch.column(1)):
                sets = shingle_sets(Words(data, offsets, fold_case=True), width)
                yield pa.record_batch([batch.column(0).slice(row, n), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, shingles binary")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def verified(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, width: int, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= similar * union, with both counts."""
    ids = pairs.select(F.col("a").alias(id_col)).union(pairs.select(F.col("b").alias(id_col))).distinct()
    sets = with_sets(restrict(docs.select(id_col, text_col), ids, id_col), id_col, text_col, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten("near_dup")
        for batch in batches:  # Spark bounds a batch by bytes, too
            both, union = [], []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                at = np.searchsorted(a, b)
                common = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0
                both.append(common)
                union.append(len(a) + len(b) - common)
            out = pa.record_batch([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "n_both", "n_union"])
            yield out.filter(pa.array([100 * i >= similar * u > 0 for i, u in zip(both, union, strict=True)], pa.bool_()))
        trim()

    joined = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
    return joined.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long, n_both long, n_union long")


def short_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, short binary): the shingle hashes of each set cut to 32 bits, sorted, for a close bound on an intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten("near_dup")
        for batch in batches:
            for row, n, data, offsets in text_slices(batch.column(1)):
                sets = [np.sort((s >> np.uint64(32)).astype("<u4")) for s in shingle_sets(Words(data, offsets, fold_case=True), width)]
                yield pa.record_batch([batch.column(0).slice(row, n), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "short"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, short binary")


def _cross_pairs(members: DataFrame, similar: int, rows_of_band: int) -> DataFrame:
    """Pairs (a, b) of different components inside a bucket whose short sets reach the similarity.

    A pair is compared only in the first band it shares.  Short sets count every common shingle, and by
    collision at most a few more: what they refuse is no link, what they let through is verified.

    members (bucket, band, id, root, n, sketch, short, main, size, others, weight): main is the component with
    most of the bucket's size rows, others the number of rows outside it, weight the shingles of all rows.
    Each row of the others is a query against all rows; queries and targets are dealt into blocks of
    bounded rows and shingles, and a block of queries meets a block of targets in one group.
    """
    number = lambda count: F.greatest(F.least(F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int"), F.col(count).cast("int")), F.lit(1))
    block = lambda count: F.pmod(F.xxhash64("id"), number(count)).cast("int")
    steps = lambda count: F.sequence(F.lit(0), number(count) - 1)
    place = lambda i, j, query: F.struct(i.alias("i"), j.alias("j"), F.lit(query).alias("query"))
    mine_i, mine_j = block("others"), block("size")
    targets = F.transform(steps("others"), lambda i: place(i, mine_j, False))
    queries = F.when(F.col("root") != F.col("main"), F.transform(steps("size"), lambda j: place(mine_i, j, True))).otherwise(F.array().cast("array<struct<i:int,j:int,query:boolean>>"))
    dealt = members.withColumn("p", F.explode(F.concat(targets, queries)))
    dealt = dealt.select("bucket", "band", F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.col("p.query").alias("query"), "id", "root", "n", "sketch", "short")

    def compare(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of each (bucket, i, j) of a table sorted by these."""
        bucket, i, j, query, ids, roots, n = (rows.column(c).to_numpy() for c in ("bucket", "i", "j", "query", "id", "root", "n"))
        sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype="<u2").reshape(len(ids), -1)
        bands, shorts = rows.column("band").to_numpy(), rows.column("short").combine_chunks()
        sets: dict[int, np.ndarray] = {}

        def short(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = np.frombuffer(shorts[int(k)].as_buffer(), dtype="<u4")
            return sets[k]

        new = (np.diff(bucket, prepend=bucket[:1]) != 0) | (np.diff(i, prepend=i[:1]) != 0) | (np.diff(j, prepend=j[:1]) != 0)
        cuts = [0, *np.flatnonzero(new), len(ids)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            asked = query[lo:hi]
            targets = lo + np.flatnonzero(~asked)
            for x in lo + np.flatnonzero(asked):
                y = targets[(roots[targets] != roots[x]) & (100 * np.minimum(n[targets], n[x]) >= similar * np.maximum(n[targets], n[x]))]
                y = y[_agreement(sketches[y], sketches[x]) >= LEAST_AGREEING]
                if len(y):
                    equal = (sketches[y] == sketches[x]).reshape(len(y), -1, rows_of_band).all(axis=2)
                    y = y[equal.argmax(axis=1) == bands[lo]]
                a, near = short(x), []
                for k in y:
                    b = short(k)
                    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                    common = int((a[at] == b).sum())
                    if 100 * common >= similar * (len(a) + len(b) - common):
                        near.append(k)
                if near:
                    y = np.array(near)
                    yield np.minimum(ids[y], ids[x]), np.maximum(ids[y], ids[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten("near_dup")
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            rows = pa.Table.from_batches(held) if held else None
            if rows is None or not rows.num_rows:
                continue
            if batch is None:
                ready, held = rows, []
            else:  # the last group may go on in the next batch
                last = rows.slice(rows.num_rows - 1).to_pylist()[0]
                same = (rows["bucket"].to_numpy() == last["bucket"]) & (rows["i"].to_numpy() == last["i"]) & (rows["j"].to_numpy() == last["j"])
                cut = int(np.argmax(same))
                ready, held = rows.slice(0, cut), rows.slice(cut).to_batches()
            if ready.num_rows and (found := list(compare(ready))):
                yield pa.record_batch([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])
        trim()

    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    similar: int = SIMILAR,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row for each document: (id_col, n_shingles, component_id, kept).

    Documents are linked whose sets have 100 * intersection >= ``similar`` * union; ``component_id`` is
    the smallest id reachable, ``kept`` says that it is the row's own.  Ids name texts: repeated rows
    each give their row, alike.  A row without an id is linked with nothing, and kept.  Null or
    word-less text: an empty set, linked with nothing.  An empty table gives an empty one; further
    columns are ignored.
    """
    spark, rows_per_band = docs.sparkSession, rows
    scratch = Scratch(spark, "near-dup")
    feats = scratch.put(features(docs, id_col, text_col, width, bands, rows), "features")
    # texts of one set: the smallest id stands for all
    same = feats.where("n_shingles > 0 and id is not null").groupBy("fp1", "fp2", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    same = scratch.put(same, "sets")
    reps = feats.join(same.select(F.col("rep").alias("id"), "fp1", "fp2"), ["id", "fp1", "fp2"], "left_semi")
    reps = scratch.put(reps.select("id", F.col("n_shingles").alias("n"), "sketch", "bands"), "reps")

    ids = reps.select("id", "n", "sketch")

    def labelled(roots: DataFrame | None, some: int) -> DataFrame:
        """(bucket, id, root) over the first bands."""
        own = reps.select("id", "n", "bands")
        own = own.withColumn("root", F.col("id")) if roots is None else own.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        return own.select("id", "n", "root", F.posexplode(F.slice("bands", 1, some)).alias("band", "bucket"))

    links = roots = None
    for some in (FIRST_BANDS, bands):
        rows = labelled(roots, some)
        # the aggregate is written, so that AQE can split a hot key of the join
        mixed = rows.groupBy("bucket").agg(F.min(F.struct("root", "id")).alias("low"), F.max("root").alias("high")).where("low.root <> high")
        mixed = scratch.put(mixed.select("bucket", F.col("low.root").alias("main"), F.col("low.id").alias("pivot")), "mixed")
        shared = rows.join(mixed, "bucket").where("root <> main").groupBy("id", "pivot").agg(F.count("*").alias("n"))
        best = shared.groupBy(F.col("id").alias("a")).agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("b"))
        found = scratch.put(verified(docs, scratch.put(best, "stars"), id_col, text_col, width, similar).select("a", "b"), "links")
        links = found if links is None else links.union(found)
        roots = scratch.put(union_find(spark, scratch, links), "roots")

    # what is still apart within a bucket
    rows = labelled(roots, bands)
    sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("w")).groupBy("bucket")
    sizes = sizes.agg(F.max(F.struct("rows", "root")).alias("m"), F.sum("rows").alias("size"), F.sum("w").alias("weight"), F.count("*").alias("k"))
    sizes = scratch.put(sizes.where("k > 1").select("bucket", F.col("m.root").alias("main"), "size", "weight", (F.col("size") - F.col("m.rows")).alias("others")), "apart")
    crossing = scratch.put(rows.drop("n").join(sizes, "bucket"), "crossing")
    apart = scratch.put(crossing.select(F.col("id").alias(id_col)).distinct(), "crossing-ids")
    near = ids.join(short_sets(restrict(docs.select(id_col, text_col), apart, id_col), id_col, text_col, width), "id")
    rest = scratch.put(_cross_pairs(crossing.join(near, "id"), similar, rows_per_band).distinct(), "pairs")
    more = scratch.put(verified(docs, rest, id_col, text_col, width, similar).select("a", "b"), "links")
    root_of = roots if more.isEmpty() else scratch.put(union_find(spark, scratch, links.union(more)), "roots")

    label = same.join(root_of.withColumnRenamed("node", "rep"), "rep", "left").select("fp1", "fp2", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    out = feats.select("id", "n_shingles", "fp1", "fp2").join(label, ["fp1", "fp2", "n_shingles"], "left")
    root = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", root.alias("component_id"), F.col("id").eqNullSafe(root).alias("kept"))

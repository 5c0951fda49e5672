"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio; DataFrame operations only.

N-grams (single words up to ``n`` words in a row, lower case) are hashed into buckets.  Two multinomials
are counted over them, one over all documents and one over the trusted documents (labels with
quality 1).  A document's score is the mean over its n-grams of

    log((t_b + k f) / (r_b + k)) - log f,      f = trusted n-grams / all n-grams,

that is the log-likelihood ratio of trusted to raw, divided by length; k pulls buckets with few
counts towards 0, so that n-grams seen once decide nothing.  Documents under ``least`` are rejected:
the threshold is fixed, no sampling.

The number of buckets grows with the corpus as a vocabulary does, with the square root of its
characters: 16,384 at least, half a million at 30 GB, 32 million (256 MB of doubles) at 100 TB.  The counts
combine map-side into at most as many rows a task; they reach the scoring plan as a scalar
subquery of one double a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS
from .line_dedup import bound

LEAST_BUCKETS = 16_384
PRIOR = 100.0
LEAST = -0.06
N = 2
#: Up to so many different repeated windows of a text are looked up one by one; more are found by a sort.
FEW = 16
SPACE = "[\\x20\\x09-\\x0D]+"


def buckets_for(chars: int) -> int:
    """The power of two from 2.5 * sqrt(chars) on."""
    return max(LEAST_BUCKETS, 1 << (int(2.5 * max(chars, 1) ** 0.5) - 1).bit_length())


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def _steps(n: Column) -> Column:
    """0 .. n - 1"""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _bucket(buckets: int, *words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int")


def grams(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(t, bucket) of each n-gram, 1 to n words long, of the arrays h of lower-case words.

    A row for each word with the words behind it, then one for each n-gram: both are generated code,
    where a lambda over the array would be interpreted.
    """
    names = [f"w{k}" for k in range(n)]
    behind = F.arrays_zip(*(F.slice("h", k + 1, F.greatest(F.size("h") - k, F.lit(0))).alias(names[k]) for k in range(n)))
    rows = texts.select("t", F.inline(behind).alias(*names))
    of = [F.when(F.col(names[k]).isNotNull(), _bucket(buckets, *names[: k + 1])) for k in range(n)]
    return rows.select("t", F.explode(F.array(*of)).alias("bucket")).where("bucket is not null")


def counts(docs: DataFrame, trusted: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, r, t) over the whole texts of docs (id, text): of all, and of those in trusted (distinct ids)."""
    marked = trusted.select("id", F.lit(1).alias("t"))
    if trusted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        marked = F.broadcast(marked)
    texts = docs.join(marked, "id", "left")
    found = grams(texts.select("t", words_of(F.lower("text")).alias("h")), n, buckets)
    return found.groupBy("bucket").agg(F.count("*").alias("r"), F.count("t").alias("t"))


def weights(counted: DataFrame, buckets: int, prior: float) -> DataFrame:
    """One row with w: array<double>, the log ratio of each bucket; all 0 where there is no trusted text."""
    every = counted.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counted, "bucket", "left").fillna(0, ["r", "t"])
    # a bucket has one row, so what meets in one task is bounded by the number of buckets
    rows = both.agg(F.sort_array(F.collect_list(F.struct("bucket", "r", "t"))).alias("rows"), F.sum("r").alias("R"), F.sum("t").alias("T"))
    f = F.col("T") / F.col("R")
    log = F.transform("rows", lambda x: F.log((x["t"] + prior * f) / (x["r"] + prior)) - F.log(f))
    return rows.select(F.when(F.col("T") > 0, log).otherwise(F.array_repeat(F.lit(0.0), buckets)).alias("w"))


def repeat_words(w: Column) -> Column:
    """How many of the words w lie in 3-word windows that the text has twice or more."""
    hashed = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    def by_value(h: Column, again: Column) -> Column:
        return covered(F.filter(_steps(F.size(h)), lambda i: F.array_contains(again, F.get(h, i))))

    def by_sort(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = bound(placed, lambda s: F.filter(s, lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]))))
        return covered(F.transform(twice, lambda x: x["i"]))

    def repeated(h: Column) -> Column:
        again = F.array_distinct(bound(F.sort_array(h), lambda s: F.filter(s, lambda x, k: F.get(s, k + 1) == x)))
        found = bound(again, lambda v: F.when(F.size(v) == 0, F.lit(0)).when(F.size(v) <= FEW, by_value(h, v)).otherwise(by_sort(h)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found)

    return bound(hashed, repeated)


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = N,
    buckets: int | None = None,
    prior: float = PRIOR,
    least: float = LEAST,
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    labels (doc_id, quality): documents with quality 1 are trusted.  A null or empty text has no words,
    fails the base rules and scores 0.  Without trusted documents every score is 0 and the base rules
    decide.  A null id is not trusted and judged like any other.  Repeated rows are judged alike; other
    columns are kept, whatever their names, but own ones of the names above are replaced.  An empty
    table gives an empty one.  ``buckets``: by the size of the corpus if not given (one more pass).
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if buckets is None:
        buckets = buckets_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("id")).where("id is not null").distinct()
    w = weights(counts(texts, trusted, n, buckets), buckets, prior).scalar()
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")

    def score(words: Column, w: Column) -> Column:
        def of(h: Column) -> Column:
            def around(x: Column, i: Column) -> Column:
                found = [F.get(w, _bucket(buckets, x))]
                found += [F.when(i < F.size(h) - k + 1, F.get(w, _bucket(buckets, x, *(F.get(h, i + j) for j in range(1, k))))).otherwise(0.0) for k in range(2, n + 1)]
                return sum(found[1:], found[0])

            return F.aggregate(F.transform(h, around), F.lit(0.0), lambda acc, x: acc + x)

        grams = sum((F.greatest(F.size(words) - k, F.lit(0)) for k in range(1, n)), F.size(words))
        return F.when(F.size(words) > 0, bound(F.transform(words, F.lower), of) / grams).otherwise(F.lit(0.0))

    def judge(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
            score(words, F.col("w")).alias("score"),
        )

    # own columns travel in a struct, where their names clash with nothing; the subquery is a column of
    # its own, as lambdas may not hold one
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")).withColumn("w", w)
    own = F.col("own")
    full = F.coalesce(own[text_col], F.lit(""))
    lines = F.filter(F.split(full, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = rows.select(
        "own",
        bound(words_of(own[text_col]), judge).alias("b"),
        F.regexp_count(full, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n_words, repeat = F.col("b.n_words"), F.col("b.n_repeat_words")
    failed = (n_words < 50) | (100 * repeat > 50 * n_words)
    return out.select(
        *[own[c].alias(c) for c in docs.columns if c not in added],
        n_words.alias("n_words"),
        F.col("b.word_chars").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        repeat.alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col("b.score").alias("score"),
        (~failed & (F.col("b.score") >= least)).alias("kept"),
    )

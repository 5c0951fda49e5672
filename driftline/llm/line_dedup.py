"""Line dedup by overlapping three-line windows, in DataFrame operations only.

The lines of a text are its ``\\n``-split parts; only lines with a word take part.  Every run of
``width`` such lines is hashed (128 bits).  A window whose lines also stand earlier, in the order of
(id, line), is a later occurrence; the lines that later occurrences cover are removed together.

One aggregation by window hash (combined map-side, so a window in every document is one row per
task) finds the first place of each repeated window; the repeated ones are joined back to their
places on the hash, where AQE splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WIDTH = 3


def bound(value: Column, body) -> Column:
    """body(value) with value evaluated once: inside lambdas Spark would evaluate an inlined column again for each element."""
    return F.transform(F.array(value), body)[0]


def _full(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def _row_key(id_col: str, text_col: str) -> Column:
    """Names a document: rows of one id and text are one."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))


def window_places(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(row, at, w1, w2): each window of ``width`` consecutive lines with words; at counts such lines from 0."""
    lines = F.filter(F.split(F.coalesce(text_col, F.lit("")), "\n", -1), _full)
    both = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(width), x).alias("b")))

    def windows(h: Column) -> Column:
        last = F.size(h) - width
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(*(F.get(h, i + k)["a"] for k in range(width))).alias("w1"), F.xxhash64(*(F.get(h, i + k)["b"] for k in range(width))).alias("w2")))

    return docs.select(_row_key(id_col, text_col).alias("row"), F.inline(bound(both, windows)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of docs with the text deduplicated, and n_lines, n_removed (lines with words, before and removed).

    A line goes if a window of ``width`` lines that covers it has an equal window earlier in the order
    of (id, line); the first occurrence stays.  The other lines, blank ones too, stay as they are,
    joined by ``\\n``.  Null text stays null; texts with fewer lines stay whole; a null id comes before
    all others.  Repeated rows (equal id and text) are one document and come out alike; of different
    texts under one id, the one with the smaller hash is the earlier.  Further columns are kept,
    whatever their names, but for own ``n_lines`` and ``n_removed``, which are replaced.  An empty table
    gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    places = scratch.put(window_places(docs, id_col, text_col, width), "windows")
    firsts = places.groupBy("w1", "w2").agg(F.min(F.struct("row", "at")).alias("first"), F.count("*").alias("n"))
    firsts = scratch.put(firsts.where("n > 1").select("w1", "w2", "first"), "repeated")
    later = places.join(firsts, ["w1", "w2"]).where(F.struct("row", "at") > F.col("first"))
    marks = later.groupBy("row").agg(F.collect_set("at").alias("at")).select(F.col("row").alias("marked"), "at")
    # own columns travel in a struct, where their names clash with nothing
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), _row_key(id_col, text_col).alias("row"))
    joined = rows.join(marks, F.col("row.id").eqNullSafe(F.col("marked.id")) & (F.col("row.text") == F.col("marked.text")), "left")

    own = F.col("own")
    text = F.coalesce(own[text_col], F.lit(""))
    lines = F.split(text, "\n", -1)
    # number the lines with words, then drop those that a marked window covers
    gone = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + width - 1))))

    def keep(parts: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: _full(F.get(parts, i)))
        drop = bound(full, lambda f: F.transform(gone, lambda g: F.get(f, g)))
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drop)
        return F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")

    n_lines = F.size(F.filter(lines, _full)).cast("long")
    # most texts have no mark, and a text that is covered from end to end keeps its blank lines only
    kept = F.when(F.col("at").isNull(), own[text_col]).otherwise(bound(lines, keep))
    made = joined.select("own", F.struct(n_lines.alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), kept.alias("text")).alias("made"))
    return made.select(
        *[own[c].alias(c) for c in docs.columns if c not in (text_col, "n_lines", "n_removed")],
        F.col("made.n_lines").alias("n_lines"),
        F.col("made.n_removed").alias("n_removed"),
        F.col("made.text").alias(text_col),
    )


#: The same in DuckDB: windows as joined text, the whole table.
ORACLE = """
WITH lines AS (
  SELECT doc_id, k, string_split(coalesce(text, ''), chr(10))[k] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(k)
), fulls AS (
  SELECT doc_id, k, line, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), windows AS (
  SELECT doc_id, pos, sha256(line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w) AS h
  FROM fulls WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS r FROM windows WHERE h IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM ranked, (VALUES (0), (1), (2)) AS s(d) WHERE r > 1
), per AS (
  SELECT l.doc_id, count(f.pos) AS n_lines, count(g.pos) AS n_removed,
         string_agg(l.line, chr(10) ORDER BY l.k) FILTER (WHERE g.pos IS NULL) AS kept
  FROM lines l LEFT JOIN fulls f ON l.doc_id = f.doc_id AND l.k = f.k
  LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.pos = g.pos GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM per
"""


def digests(result: DataFrame) -> DataFrame:
    """The operator's rows with the hash of the kept text instead of the text."""
    return result.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))

"""Errors of a source with the lines around them: error lines, Python tracebacks, Go stack traces.

Both passes read the lines of a source in order, as a stream: a task holds one batch and the context
of one error, whatever the length of the source.  Patterns and timestamps are worked out in the JVM.
Positions within a line are in characters.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times, words

PYTHON, GO, ROUTINE = "Traceback (most recent call last):", "panic:", "goroutine "
BEFORE_HEADER = " \t:|"
HISTORY = AFTER = 3
DISTANCE = 0.5
PLAIN, MORE, DONE = "plain", "more", "done"
TIME_ONLY = "^.{6}[0-9]{2}:[0-9]{2}:[0-9]{2}\\.[0-9]{3}|^[A-Z][a-z]{2} {1,2}[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2} "


def _header(line: str, needle: str) -> int:
    """Where a header stands, or -1: at the start or behind a separator."""
    at = line.find(needle)
    return at if at <= 0 or line[at - 1] in BEFORE_HEADER else -1


def _in_trace(line: str, at: int) -> bool:
    """Whether a line goes on with a stack trace that is indented by at."""
    rest = line[at:]
    call = rest[:1].isascii() and rest[:1].islower() and rest.endswith(")") and "(" in rest
    return not rest or call or rest.startswith((ROUTINE, "created by")) or rest[at : at + 1] == "\t"


def kinds() -> Generator[str | None, str, None]:
    """Takes lines in order and says of each: plain, more (within a trace) or done (the line that ends one)."""
    line = yield None
    while True:
        if (at := _header(line, PYTHON)) >= 0:
            line = yield MORE
            while line[at : at + 1] in ("", " "):
                line = yield MORE
            line = yield DONE
        elif (at := _header(line, GO)) >= 0:
            line = yield MORE
            while line[at : at + 1] == "[":
                line = yield MORE
            trace = len(line) <= at  # a blank line must follow, then a routine; if not, it was no panic
            if trace:
                line = yield MORE
                trace = line.startswith(ROUTINE, at)
            while trace and _in_trace(line, at):
                line = yield MORE
            line = yield DONE if trace else "none"
        else:
            line = yield PLAIN


def _by_source(df: DataFrame, of_source: Callable[[], Generator], columns: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """Rows that a coroutine of each source returns for its rows, sent in order, and at last for None."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, machine = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if machine is None or row[0] != source:
                    if machine is not None:
                        out += machine.send(None)
                    source, machine = row[0], of_source()
                    next(machine)
                out += machine.send(dict(zip(names, row, strict=True)))
            yield _batch(out, columns)
        if machine is not None:
            yield _batch(machine.send(None), columns)

    return df.repartition(names[0]).sortWithinPartitions(names[0], "seq").mapInArrow(run, schema)


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(columns)], names=[n for n, _ in columns])


def marked(lines: DataFrame) -> DataFrame:
    """lines (source string, seq, pos long, line) with kind and error: whether an error is complete in the line."""

    def machine() -> Generator:
        said, row = kinds(), (yield [])
        next(said)
        while row is not None:
            kind = said.send(row["line"])
            row = yield [(row["source"], row["seq"], row["pos"], row["line"], kind, kind == DONE or kind == PLAIN and row["matches"])]
        yield []

    columns = [("source", pa.string()), ("seq", pa.int64()), ("pos", pa.int64()), ("line", pa.string()), ("kind", pa.string()), ("error", pa.bool_())]
    rows = lines.select("source", "seq", "pos", "line", words.is_error_line(F.col("line")).alias("matches"))
    return _by_source(rows, machine, columns, "source string, seq long, pos long, line string, kind string, error boolean")


def _with_repeats(rows: DataFrame, key: F.Column) -> DataFrame:
    """rows with repeat: an error of the same key came earlier (by source, then seq)."""
    keyed = rows.withColumn("key", F.when(F.col("error"), F.sha2(key, 256)))
    first = keyed.where("error").groupBy("key").agg(F.min(F.struct("source", "seq")).alias("one"))
    return keyed.join(first, "key", "left").withColumn("repeat", F.coalesce(F.struct("source", "seq") != F.col("one"), F.lit(False))).drop("key", "one")


def error_contexts(lines: DataFrame, ignore: str | None = None, key: F.Column | None = None) -> DataFrame:
    """(source, pos, line, before, after, ts_ms, distance): one row for each error.

    ``before`` holds the lines since the last context, three at most, with the whole trace that the line
    ends; none if it follows an error's own context.  ``after`` ends after three lines or at the next error
    or trace.  Lines that match ``ignore`` are passed over.  With ``key`` (a column over ``line``) only the
    first error of a key counts.  ts_ms: of the line, else of the first dated line of ``before``; null for
    a time without a date.  Lines are (source, seq, pos, line) without nulls; (source, seq) is unique.
    """
    rows = marked(lines)
    line = F.col("line")
    rows = rows.withColumn("ignored", line.rlike(ignore) if ignore else F.lit(False))
    # an ignored line is passed over before it can count as the first of its key
    rows = _with_repeats(rows.withColumn("error", F.col("error") & ~F.col("ignored")), key) if key is not None else rows.withColumn("repeat", F.lit(False))
    rows = rows.withColumn("ts", times.full_timestamp(line)).withColumn("clock", line.rlike(TIME_ONLY))

    def machine() -> Generator:
        history: list[dict] = []
        current: tuple | None = None
        row = yield []
        while row is not None:
            ended: list[tuple] = []
            if row["kind"] == MORE:
                history.append(row)
                if current:
                    ended, current = [current], None
            elif row["ignored"] or row["repeat"]:
                pass
            elif row["error"]:
                dated = next((r for r in (row, *history) if r["ts"] is not None or r["clock"]), row)
                before = [] if current else [r["line"] for r in history]
                if current:
                    ended = [current]
                else:
                    history = []
                current = (row["source"], row["pos"], row["line"], before, [], dated["ts"], DISTANCE)
            elif current:
                current[4].append(row["line"])
                if len(current[4]) == AFTER:
                    ended, current = [current], None
            else:
                history = [*history[max(0, len(history) - HISTORY + 1) :], row]
            row = yield ended
        yield [current] if current else []

    texts = pa.list_(pa.string())
    columns = [("source", pa.string()), ("pos", pa.int64()), ("line", pa.string()), ("before", texts), ("after", texts), ("ts_ms", pa.int64()), ("distance", pa.float64())]
    rows = rows.select("source", "seq", "pos", "line", "kind", "error", "ignored", "repeat", "ts", "clock")
    return _by_source(rows, machine, columns, "source string, pos long, line string, before array<string>, after array<string>, ts_ms long, distance double")

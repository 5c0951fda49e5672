"""Timestamps of log lines, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def _full(line: Column, pattern: str, form: str) -> Column:
    return F.unix_millis(F.try_to_timestamp(F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")), F.lit(form)))


def full_timestamp(line: Column) -> Column:
    """Milliseconds since the epoch of a leading date and time, or null; the zone is ignored (session zone UTC)."""
    day, clock = "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{2}:[0-9]{2}:[0-9]{2}"
    epoch = F.regexp_extract(line, "^\\{\"date\":([0-9]+\\.[0-9]{3})", 1)
    return F.coalesce(
        F.when(epoch != "", (epoch.cast("decimal(20,3)") * 1000).cast("bigint")),
        _full(F.regexp_replace(line, f"^({day} {clock}),", "$1."), f"^({day} {clock}\\.[0-9]{{3}})", "yyyy-MM-dd HH:mm:ss.SSS"),
        _full(line, f"^({day}T{clock})", "yyyy-MM-dd'T'HH:mm:ss"),
        _full(line, f"^({day} {clock})", "yyyy-MM-dd HH:mm:ss"),
        _full(line, f"^\\[([0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}} {clock})\\]", "yyyy/MM/dd HH:mm:ss"),
    )


def with_date(reference_ms: Column, time_of_day_ms: Column) -> Column:
    """The time of day on the day that brings it within twelve hours of the reference."""
    same = reference_ms - F.pmod(reference_ms, F.lit(DAY_MS)) + time_of_day_ms
    return F.when(same - reference_ms > DAY_MS // 2, same - DAY_MS).when(reference_ms - same > DAY_MS // 2, same + DAY_MS).otherwise(same)


def time_of_day(line: Column) -> Column:
    """Milliseconds since midnight of a time without a date: from the seventh character on, or after month and day; else null."""
    clock = lambda p: F.regexp_extract(line, p, 0)
    klog, plain = "^.{6}([0-9]{2}:[0-9]{2}:[0-9]{2}\\.[0-9]{3})", "^[A-Z][a-z]{2} {1,2}[0-9]{1,2} ([0-9]{2}:[0-9]{2}:[0-9]{2}) "

    def ms(x: Column) -> Column:
        part = lambda at, n: F.substring(x, at, n).cast("long")
        whole = (part(1, 2) * 3600 + part(4, 2) * 60 + part(7, 2)) * 1000 + F.coalesce(F.try_to_number(F.nullif(F.substring(x, 10, 3), F.lit("")), F.lit("999")).cast("long"), F.lit(0))
        return F.when((part(1, 2) < 24) & (part(4, 2) < 60) & (part(7, 2) < 60), whole)

    return F.coalesce(*(F.when(clock(p) != "", ms(F.regexp_extract(line, p, 1))) for p in (klog, plain)))


def journal_stamp(micros: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS,mmm`` of microseconds since the epoch (session zone UTC)."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd HH:mm:ss,SSS")


def human_duration(ms: Column) -> Column:
    """``120ms``, ``4.50s``, ``3m07s`` or ``2h05m``."""
    s = F.floor(ms / 1000)
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    text = lambda c: c.cast("long").cast("string")
    return (
        F.when(s < 1, F.concat(text(ms), F.lit("ms")))
        .when(s < 60, F.concat(F.format_string("%.2f", ms.cast("double") / 1000), F.lit("s")))
        .when(s < 3600, F.concat(text(F.floor(s / 60)), F.lit("m"), two(s % 60), F.lit("s")))
        .otherwise(F.concat(text(F.floor(s / 3600)), F.lit("h"), two(F.floor((s % 3600) / 60)), F.lit("m")))
    )


def too_old(created: Column, now: Column, days: int) -> Column:
    """Whether a model is older than it may be."""
    return (now.cast("long") - created.cast("long")) > days * 86_400

"""Single-word predicates and line predicates as Spark columns (whole-stage codegen, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def is_uid(w: Column) -> Column:
    return w.rlike(P.HEX_LIKE) | (w.rlike(P.CONSONANT) & ~w.rlike(P.VOWEL))


def is_base64(w: Column) -> Column:
    return w.endswith("==") | ((F.octet_length(w) > 24) & (w.endswith("=") | w.rlike(P.BASE64)))


#: In the order in which a word is tried.
LITERALS = {
    "%DATE": lambda w: w.rlike(P.DATE),
    "%HASH": lambda w: ~w.startswith("/") & w.rlike(P.HASH),
    "%ID": is_uid,
    "%COOKIE": lambda w: w.rlike(P.COOKIE),
    "%UID": lambda w: w.rlike(P.UUID_TAIL),
    "%URL": lambda w: w.rlike(P.URL),
    "%PATH": lambda w: w.contains("tmp/") | w.contains("/tmp") | w.startswith("tmp"),
    "%REF": lambda w: w.rlike(P.REFS),
    "%BASE64": is_base64,
    "%UNIT": lambda w: w.rlike(P.UNIT),
}


def literal(w: Column) -> Column:
    """The placeholder of a word, or null."""
    return F.coalesce(*(F.when(test(w), F.lit(name)) for name, test in LITERALS.items()))


def remove_numbers(w: Column) -> Column:
    return F.regexp_replace(w, P.NUMBER, "N")


def is_error_line(line: Column) -> Column:
    return line.rlike("|".join(P.ERROR_LINE))


def is_noise(line: Column) -> Column:
    return ~line.rlike("\\s") | line.rlike("|".join(f"(?:{p})" for p in P.NOISE))


def dedupe_key(tokens: Column) -> Column:
    """Sorted words that are no placeholders; lines with equal keys are one."""
    return F.array_sort(F.filter(F.split(tokens, " ", -1), lambda w: ~w.startswith("%")))

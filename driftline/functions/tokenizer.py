"""The line tokenizer: noise-free words, one space apart.

It is stateful (some keys swallow the next word) and splits words again and again, so it is one
Arrow function rather than a chain of columns.  Parts of words are worked off an explicit stack, since a
word may have thousands; what a part leaves behind decides the glue that follows it.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P


def _py(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("\\z", "\\Z"), re.A)


_DATE, _ERROR, _HASH, _HEX, _COOKIE, _UUID, _URL, _REFS, _B64, _UNIT, _ODD, _NUMBER, _SPLIT = map(
    _py, (P.DATE, P.ERROR_WORD, P.HASH, P.HEX_LIKE, P.COOKIE, P.UUID_TAIL, P.URL, P.REFS, P.BASE64, P.UNIT, P.ODD, P.NUMBER, P.SPLIT)
)
_CONSONANT, _VOWEL, _NOISE = _py(P.CONSONANT), _py(P.VOWEL), _py("|".join(f"(?:{p})" for p in P.NOISE))
_DASHES, _PASSWORD = re.compile(r".+-.+-.+-."), re.compile(r"password[:=]$")
_EDGES = "'\",;()[]{}<>\\"


def _bare(word: str) -> str:
    while word.startswith('u"'):
        word = word[2:]
    while word.startswith("u'"):
        word = word[2:]
    return word.strip(_EDGES)


def _literal(w: str) -> str | None:
    size = len(w.encode())
    tests = (
        ("%DATE", _DATE.match(w)),
        ("%HASH", not w.startswith("/") and (_HASH.match(w) or _HASH.search(w))),
        ("%ID", _HEX.match(w) or (_CONSONANT.search(w) and not _VOWEL.search(w))),
        ("%COOKIE", _COOKIE.match(w)),
        ("%UID", _UUID.match(w)),
        ("%URL", _URL.match(w)),
        ("%PATH", "tmp/" in w or "/tmp" in w or w.startswith("tmp")),
        ("%REF", _REFS.match(w)),
        ("%BASE64", w.endswith("==") or (size > 24 and (w.endswith("=") or _B64.match(w)))),
        ("%UNIT", _UNIT.match(w)),
    )
    return next((name for name, hit in tests if hit), None)


def _parts(raw: str, rest: Iterator[str]) -> Generator[str, tuple[str, bool], tuple[str, bool]]:
    """The tokens of one word; yields its parts and is sent theirs."""
    w = _bare(raw)
    if not w:
        return "", False
    if name := _literal(w):
        return name, True
    if _ERROR.match(w):
        return " ".join([w, *(w + s for s in ("%A", "%B", "%C", "%D"))]), True
    if len(w.encode()) <= 3:
        return "", False
    if (head := w.rstrip("0123456789")).endswith("["):
        return (yield head[:-1])[0] + "%PID", True
    if _ODD.search(w):
        return "%ODD", True
    cut = min((w.find(c) for c in "=:" if c in w), default=-1)
    if cut > 0 and (w[0] == "_" or w[0].isascii() and w[0].isalpha()):
        key, value = w[:cut], w[cut + 1 :]
        said = (yield key)[0]
        if any(k in key.lower() for k in P.KEY_IDS):
            if not value:
                next(rest, None)
            return said + "%EQ %VALUE_ID", True
        more, added = yield value
        return said + "%EQ " + more, added
    for sign in "/-|":
        if sign in w:
            left, right = w.split(sign, 1)
            if sign == "-" and _DASHES.match(right):
                return "%DASH", True
            one, glue = yield left
            two, added = yield right
            return one + (f"{sign} " if glue else "") + two, added
    if len(w.encode()) >= 32:
        return "%BIG", True
    if (at := min((w.find(c) for c in "[(\\@" if c in w), default=-1)) >= 0:
        one, glue = yield w[:at]
        two, added = yield w[at + 1 :]
        return one + (" " if glue else "") + two, added
    plain = _NUMBER.sub("N", w)
    if _PASSWORD.search(plain):
        next(rest, None)
        return plain, True
    return (plain, True) if len(plain.encode()) > 3 else ("", False)


def _word(raw: str, rest: Iterator[str]) -> tuple[str, bool]:
    """(text, whether a word was added): the tokens of one word."""
    open_, said = [_parts(raw, rest)], None
    while open_:
        try:
            part = open_[-1].send(said)
            open_.append(_parts(part, rest))
            said = None
        except StopIteration as done:
            open_.pop()
            said = done.value
    return said


def tokenize(line: str) -> str:
    """Tokens of one line."""
    line = line.strip()
    if not any(c.isspace() for c in line) or _NOISE.search(line):
        return "%GL_FILTER"
    rest = iter(_SPLIT.split(line))
    out = []
    for raw in rest:
        text, added = _word(raw, rest)
        out.append(text + (" " if added else ""))
    return "".join(out).rstrip()


#: Lines repeat: a worker remembers the tokens of so many.
_known = lru_cache(1 << 14)(tokenize)


def _tokens(lines: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _known(x) for x in lines.to_pylist()], pa.string())


def tokens_of(line: Column) -> Column:
    """The tokens of a column of lines, in Arrow batches; null where the line is null."""
    return F.arrow_udf(_tokens, "string")(line)


def with_tokens(lines: DataFrame, column: str = "line", name: str = "tokens") -> DataFrame:
    return lines.withColumn(name, tokens_of(F.col(column)))

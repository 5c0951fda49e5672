"""Lines of raw text by the separators of its format.

Text: a newline, a literal backslash-n, and the start of a task's ``stdout_lines``.  JSON adds the
punctuation outside strings, XML the place between two tags.  A backslash takes the next character
with it, so an escaped newline joins two lines.  One compiled pattern a format finds separators and
whatever must be passed over; texts go through Arrow batches and lines leave in bounded ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

_ESCAPE = r"(?P<sub>\\n)|\\(?s:.)"
_LINE = r'(?P<line>\n|"(?=, "stdout_lines": \[))'
_MORE = {"text": "", "json": r'|(?P<quote>")|(?P<piece>[,\[\]{}])', "xml": "|(?P<tag>(?<=>)(?=<))"}
FORMATS = {name: re.compile(f"{_ESCAPE}|{_LINE}{more}") for name, more in _MORE.items()}
ROWS_OUT = 20_000


def pieces(text: str, form: str = "text") -> Iterator[tuple[int, str]]:
    """(pos, line) of non-empty lines; pos counts newlines only, from 1.  Lines over the limit are counted, not returned."""
    start, pos, quoted = 0, 1, False
    for found in FORMATS[form].finditer(text):
        what = found.lastgroup
        if what == "quote":
            quoted = not quoted
        elif what and not (what == "piece" and quoted):
            yield from _kept(pos, text[start : found.start()])
            start = found.end()
            pos += what == "line"
    yield from _kept(pos, text[start:])


def _kept(pos: int, line: str) -> Iterator[tuple[int, str]]:
    if line and (len(line) * 4 <= P.MAX_LINE_BYTES or len(line.encode()) <= P.MAX_LINE_BYTES):
        yield pos, line


def split(docs: DataFrame, id_col: str, text_col: str, form: Column | str = "text") -> DataFrame:
    """(id_col, seq, pos, line): seq orders the lines of a text, pos is their number in it.  Null text: no lines.

    ``form`` is text, json or xml, or a column of these (``paths.file_format``).
    """
    kind = docs.schema[id_col].dataType
    form = F.lit(form) if isinstance(form, str) else form

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, forms = batch.columns
            owner: list[int] = []
            rows: list[tuple[int, int, str]] = []

            def out() -> pa.RecordBatch:
                seq, pos, line = zip(*rows, strict=True)
                return pa.record_batch([ids.take(pa.array(owner)), pa.array(seq, pa.int64()), pa.array(pos, pa.int64()), pa.array(line, pa.string())], names=[id_col, "seq", "pos", "line"])

            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if text is None:
                    continue
                for seq, (pos, line) in enumerate(pieces(text, forms[i].as_py()), 1):
                    owner.append(i)
                    rows.append((seq, pos, line))
                    if len(rows) == ROWS_OUT:
                        yield out()
                        owner.clear()
                        rows.clear()
            if rows:
                yield out()

    return docs.select(id_col, F.col(text_col).alias("text"), form.alias("form")).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, seq long, pos long, line string")

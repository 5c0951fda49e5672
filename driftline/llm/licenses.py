"""License scans by conditional compression.

Every license word of a text opens a window of the words around it, across lines and sentences and
long stretches in overlapping pieces.  Each template is aligned with the window (local alignment of
words); what it covers, whether a sentence, a part of one or a run of wrapped lines, is a candidate
block.  The block is compressed with zstandard alone and with the template as raw dictionary; the share
of bytes saved must be large, and of blocks that overlap the one that saves most bytes is taken.  The
exact wording then confirms it: the words that differ between the block and the template (or the stretch
of it that the block quotes, if that is long), whose share must stay small, and no word that tells
licenses apart (name, version, terms) may differ or be missing.  If it does not, the next one is taken.

Texts without a license word never leave the JVM.  Savings of equal blocks are remembered (bounded).
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wordings of public licenses and of their usual notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "MPL-1.1": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "all-rights-reserved": ["All rights reserved."],
}
WORDS = "(?i)licen[sc]e|copyright|all\\W+rights\\W+reserved|permission\\W+is\\W+hereby|redistribution\\W+and\\W+use|redistribute\\W+it|creative\\W+commons|\\bCC\\WBY\\b|public\\W+domain"
LEAST_SAVED, MOST_DIFFERENT = 0.3, 0.25
#: A template may be quoted in part by so many of its words.
QUOTE = 12
#: Words in a piece of a window; pieces overlap by two reaches.
PIECE = 600
_CANDIDATE = re.compile(WORDS)
#: A hyphenated word may be broken behind its hyphen, before the marks of a comment.
_WORD = re.compile(r"\w+(?:(?:\.|-(?:\r?\n[\s#*/;%!>]*)?)\w+)*")
_BREAK = re.compile(r"-\r?\n[\s#*/;%!>]*")
#: Words that tell one license from another.
_NAMING = re.compile(
    r"v?\d{1,2}(?:\.\d+)*|\d-clause|clause|mit|isc|x11|apache|gnu|l?gpl(?:v\d.*)?|agpl(?:v\d.*)?|lesser|library|affero|general|bsd|mozilla|mpl|eclipse|european|cc0?|by|sa|nc|nd|by(?:-\w+)+"
    r"|attribution(?:-\w+)*|sharealike|noncommercial|noncommercial-\w+|noderivatives|noderivs|noderivs-\w+"
)


@lru_cache(1)
def _templates() -> list[tuple[str, list[str], frozenset[str], int, zstandard.ZstdCompressor]]:
    """(name, words, naming words, reach in words, compressor) of each template."""
    out = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words = _WORD.findall(text.lower())
            # a block differs by a quarter of its words at most
            out.append((name, words, frozenset(filter(_NAMING.fullmatch, words)), len(words) * 4 // 3 + 1, zstandard.ZstdCompressor(dict_data=raw, level=19)))
    return out


@lru_cache(1)
def _alone() -> tuple[zstandard.ZstdCompressor, int]:
    c = zstandard.ZstdCompressor(level=19)
    return c, len(c.compress(b""))


@lru_cache(50_000)
def _saved(block: str, k: int) -> tuple[int, float]:
    """The block's compressed bytes that template k saves, and their share."""
    c, frame = _alone()
    raw = block.encode(errors="replace")
    alone, given = len(c.compress(raw)) - frame, len(_templates()[k][4].compress(raw)) - frame
    return alone - given, 1 - given / max(1, alone)


def _align(theirs: list[str], mine: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """Best local alignment: its score, and the pairs of places with equal words.  A match is worth 1, other steps -1."""
    best, at, rows = 0, (0, 0), [[0] * (len(mine) + 1)]
    for i, t in enumerate(theirs, 1):
        up, row, left = rows[-1], [0], 0
        for j, w in enumerate(mine, 1):
            x = up[j - 1] + 1 if w == t else up[j - 1] - 1
            left = max(x, left - 1, up[j] - 1, 0)
            row.append(left)
            if left > best:
                best, at = left, (i, j)
        rows.append(row)
    (i, j), pairs = at, []
    while rows[i][j]:
        equal = theirs[i - 1] == mine[j - 1]
        if rows[i][j] == rows[i - 1][j - 1] + (1 if equal else -1):
            i, j = i - 1, j - 1
            if equal:
                pairs.append((i, j))
        elif rows[i][j] == rows[i - 1][j] - 1:
            i -= 1
        else:
            j -= 1
    return best, pairs[::-1]


def _confirm(theirs: list[str], naming: frozenset[str], mine: list[str], pairs: list[tuple[int, int]]) -> tuple[int, str] | None:
    """(words that differ, the differences), if the wording is near enough and no naming word differs."""
    changes, at = [], pairs[0]
    for i, j in pairs:
        if (i, j) != at:
            changes.append((theirs[at[0] : i], mine[at[1] : j]))
        at = (i + 1, j + 1)
    missing = [x for x in (theirs[: pairs[0][0]], theirs[at[0] :]) if x]
    if at[0] - pairs[0][0] < min(len(theirs), QUOTE):
        changes += [(x, []) for x in missing]
    elif any(w in naming for x in missing for w in x):
        return None
    if any(_NAMING.fullmatch(w) for old, new in changes for w in (*old, *new)):
        return None
    n = sum(max(len(old), len(new)) for old, new in changes)
    if n > MOST_DIFFERENT * max(at[0] - pairs[0][0], at[1] - pairs[0][1]):
        return None
    return n, "; ".join(f"-{' '.join(old)} +{' '.join(new)}" for old, new in changes)


def _windows(text: str, words: list[re.Match]) -> Iterator[tuple[int, int]]:
    """Ranges of words near a license word, in overlapping pieces."""
    reach = max(t[3] for t in _templates())
    starts, ranges = [w.start() for w in words], []
    for m in _CANDIDATE.finditer(text):
        k = bisect.bisect_right(starts, m.start()) - 1
        lo, hi = max(0, k - reach), min(len(words), k + reach + 1)
        if ranges and lo <= ranges[-1][1]:
            ranges[-1][1] = hi
        else:
            ranges.append([lo, hi])
    for lo, hi in ranges:
        while hi - lo > PIECE:
            yield lo, lo + PIECE
            lo += PIECE - 2 * reach
        yield lo, hi


def notices(text: str) -> list[tuple[int, int, str, float, int, str]]:
    """(start, end, license, share saved, words that differ, the differences) of the confirmed blocks, by place."""
    words = list(_WORD.finditer(text))
    lower = [_BREAK.sub("-", w[0].lower()) for w in words]
    found = {}
    for lo, hi in _windows(text, words):
        held = set(lower[lo:hi])
        for k, (name, theirs, naming, _, _) in enumerate(_templates()):
            if not naming <= held or sum(t in held for t in theirs) < min(QUOTE * 0.75, len(theirs) * 2 / 3):
                continue
            todo = [(lo, hi)]
            while todo:
                # what is left on both sides of an alignment may hold another
                a, b = todo.pop()
                score, pairs = _align(theirs, lower[a:b])
                if score * 2 < min(len(theirs), QUOTE) - 1:
                    continue
                c, d = a + pairs[0][1], a + pairs[-1][1] + 1
                todo += [(x, y) for x, y in ((a, c), (d, b)) if y > x]
                start, end = words[c].start(), words[d - 1].end()
                while end < len(text) and text[end] in ".:;!?)\"'":
                    end += 1
                saved, share = _saved(re.sub(r"\s[\s#*/;%!>-]*", " ", text[start:end]), k)
                if share >= LEAST_SAVED:
                    found[c, d, k] = (saved, len(pairs), (start, end, name, share), (a, b, pairs))
    # those that save most bytes first, none over another
    out: list[tuple] = []
    for (c, d, k), (_, _, row, (a, b, pairs)) in sorted(found.items(), key=lambda x: (-x[1][0], -x[1][1], x[0])):
        if all(d <= o[0] or o[1] <= c for o in out) and (verdict := _confirm(*_templates()[k][1:3], lower[a:b], pairs)):
            out.append((c, d, (*row, *verdict)))
    return [tuple(row) for _, _, row in sorted(out, key=lambda o: o[0])]


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each confirmed block: (doc_id, start, end, license, saved, n_different, differences).

    Places are code points, end exclusive.  Null and empty texts give no rows; repeated rows each give
    theirs; further columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(doc, start, end, name, round(saved, 4), n, said) for start, end, name, saved, n, said in notices(text)]
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "end", "license", "saved", "n_different", "differences"])

    likely = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(WORDS))
    return likely.mapInArrow(run, "doc_id long, start long, `end` long, license string, saved double, n_different long, differences string")

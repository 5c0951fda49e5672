import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.operators import errors, splitting


@pytest.mark.parametrize(
    ("text", "form", "lines"),
    [
        ("first\nsecond\n\nfourth\\nsub4", "text", [(1, "first"), (2, "second"), (4, "fourth"), (4, "sub4")]),
        ("first\\n", "text", [(1, "first")]),
        ("a\\\nb\\\\nc", "text", [(1, "a\\\nb\\\\nc")]),
        ("a" * 6001 + "\nsecond\n" + "é" * 3001 + "\n" + "é" * 3000, "text", [(2, "second"), (4, "é" * 3000)]),
        ('stdout": "one\\ntwo", "stdout_lines": ["x"],', "text", [(1, 'stdout": "one'), (1, "two"), (2, ', "stdout_lines": ["x"],')]),
        ('[42, 43,\n {"key": "value, [x]", o:[1,2]}]', "json", [(1, "42"), (1, " 43"), (2, " "), (2, '"key": "value, [x]"'), (2, " o:"), (2, "1"), (2, "2")]),
        ("<a><b>x</b>\n<c/></a>", "xml", [(1, "<a>"), (1, "<b>x</b>"), (2, "<c/>"), (2, "</a>")]),
        ("", "text", []),
    ],
)
def test_pieces(text, form, lines):
    assert list(splitting.pieces(text, form)) == lines


@given(st.text(alphabet='ab\\n\n"<>,[]{} ', max_size=40), st.sampled_from(sorted(splitting.FORMATS)))
def test_pieces_by_hand(text, form):
    """Against a walk over the characters."""
    want, held, pos, skip, quoted, last = [], "", 1, False, False, ""

    def end():
        if held:
            want.append((pos, held))

    for k, c in enumerate(text):
        if skip:
            skip = False
            if c == "n":
                held = held[:-1]
                end()
                held = ""
            else:
                held += c
        elif c == "\\":
            skip = True
            held += c
        elif c == "\n" or text.startswith('", "stdout_lines": [', k):
            end()
            held, pos = "", pos + 1
        elif form == "json" and c == '"':
            quoted, held = not quoted, held + c
        elif form == "json" and c in ",[]{}" and not quoted:
            end()
            held = ""
        elif form == "xml" and c == "<" and last == ">":
            end()
            held = c
        else:
            held += c
        last = c
    end()
    assert list(splitting.pieces(text, form)) == want


def test_split_of_a_table(spark):
    rows = spark.createDataFrame([("x", "a\nb", 1), (None, "c", 2), ("y", None, 3), ("z", "", 4)], "id string, text string, seq int")
    assert sorted(map(tuple, splitting.split(rows, "id", "text").collect()), key=repr) == sorted([("x", 1, 1, "a"), ("x", 2, 2, "b"), (None, 1, 1, "c")], key=repr)
    assert splitting.split(rows.limit(0), "id", "text").collect() == []


def told(lines):
    machine = errors.kinds()
    next(machine)
    return [machine.send(x) for x in lines]


def test_traces():
    python = ["t - Traceback (most recent call last):", 't -   File "x"', "t - RuntimeError: bam", "t - on"]
    assert told(python) == ["more", "more", "done", "plain"]
    go = ["panic: nil", "[signal]", "", "goroutine 1 [running]:", "main.main()", "\ttest.go:14", "exit status 2", "on"]
    assert told(go) == ["more"] * 6 + ["done", "plain"]
    assert told(["panic: x", "y", "z"]) == ["more", "none", "plain"]
    assert told(["panic: x", "", "y", "z"]) == ["more", "more", "none", "plain"]
    assert told(["the no-panic: x"]) == ["plain"]


def contexts(spark, texts, **options):
    lines = splitting.split(spark.createDataFrame(list(texts.items()), "source string, text string"), "source", "text")
    return {(r.source, r.pos): r for r in errors.error_contexts(lines, **options).collect()}


def test_error_contexts(spark):
    texts = {
        "trace": '\nd - Running\nd - Traceback (most recent call last):\nd -   File "t.py"\nd -     raise\nd - RuntimeError: bam\nd - went wrong\n',
        "dated": "\n2025-08-14 13:23:14 message\n| fatal: oops\n",
        "clock": "2025-08-14 13:23:14 message\nAug 14 13:23:15 x | fatal: oops",
        "many": "a\nb\nc\nd\nx ERROR\ne\ny ERROR\nf\ng\nh\ni\nz ERROR",
    }
    got = contexts(spark, texts)
    assert sorted(got) == [("clock", 2), ("dated", 3), ("many", 5), ("many", 7), ("many", 12), ("trace", 6)]
    trace = got["trace", 6]
    assert trace.before == texts["trace"].split("\n")[1:5]
    assert (trace.after, trace.ts_ms, trace.distance) == (["d - went wrong"], None, 0.5)
    assert (got["dated", 3].ts_ms, got["clock", 2].ts_ms) == (1755177794000, None)
    many = [(got["many", k].before, got["many", k].after) for k in (5, 7, 12)]
    assert many == [(["b", "c", "d"], ["e"]), ([], ["f", "g", "h"]), (["i"], [])]


def test_error_options(spark):
    texts = {"a": "one\nx ERROR\nx ERROR", "b": "two\nx ERROR\n| fatal: y\n| fatal: z"}
    got = contexts(spark, texts, ignore="z$", key=F.col("line"))
    assert sorted(got) == [("a", 2), ("b", 3)]
    assert got["b", 3].before == ["two"]
    assert contexts(spark, {"a": ""}) == {}

import gzip
import hashlib
import math
import tarfile

import duckdb
import pytest
from pyspark.sql import functions as F

from driftline.functions import paths, times, tokenizer, words
from driftline.operators import scoring
from driftline.plans import registry
from driftline.sources import archives
from driftline.streaming.scoring import score_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    want = sorted((tuple(r) for r in duck.sql(registry.oracle_sql()[name]).select(*(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize(
    ("line", "tokens"),
    [
        ("Test Fail", "Test Fail Fail%A Fail%B Fail%C Fail%D"),
        ("word", "%GL_FILTER"),
        ("iptables -N RULES42 -L", "%GL_FILTER"),
        ("the password: secret value", "password%EQ %VALUE_ID value"),
        ("seen on week Monday", "seen week %DATE"),
        ("call NTN:N:NZ now please", "call %ID please"),
    ],
)
def test_tokenizer(line, tokens):
    assert tokenizer.tokenize(line) == tokens


@pytest.mark.parametrize(("a", "b"), [("running test4.2", "running test43"), ("the_ip is 127.0.0.1", "the_ip is ::1")])
def test_tokenizer_equal(a, b):
    assert tokenizer.tokenize(a) == tokenizer.tokenize(b)


def test_tokenizer_deep_word():
    assert tokenizer.tokenize("see " + "aaaa|" * 2000).startswith("%ID| ")


def test_error_lines(spark):
    yes = ["x The error appears to be in y", "x failed: 3 ", 'msg="error reading file"', 'msg="an error occurred"', "a | FAILED | b", "E0814 x", "... FAILED", "a ERROR"]
    no = ["x failed: 0 ", "a ERROR\r", "an error", "levels=errors"]
    rows = spark.createDataFrame([(x,) for x in yes + no], "l string").select("l", words.is_error_line(F.col("l")).alias("e")).collect()
    assert {r.l: r.e for r in rows} == {x: x in yes for x in yes + no}


def test_hex_pattern_is_linear(spark):
    row = spark.range(1).select(words.is_uid(F.lit("a" * 40 + "g")).alias("no"), words.is_uid(F.lit("::1")).alias("yes")).first()
    assert (row.no, row.yes) == (False, True)


def test_set_cosine_both_forms(spark):
    base = spark.createDataFrame([("i", ["the", "third", "line", "is", "a", "warning"])], "index_name string, words array<string>")
    target = spark.createDataFrame([("i", ["a", "new", "error"]), ("i", ["other"]), ("j", ["a"]), ("i", [])], base.schema)
    for most in (10**6, 0):
        got = {(r.index_name, tuple(r.words)): r.distance for r in scoring.distances(target, base, most).collect()}
        assert math.isclose(got["i", ("a", "new", "error")], 1 - 1 / math.sqrt(18))
        assert got["i", ("other",)] == got["j", ("a",)] == got["i", ()] == 1.0


def test_set_cosine_in_blocks_equals_brute_force(spark):
    """Many small cells: a word that all sets hold, an index that only one side has, a null index, empty and repeated sets."""
    rows = [(i % 3 and "ij"[i % 2], ["all", *(f"w{i * k % 17}" for k in range(1, i % 6))], i % 4 == 0) for i in range(120)]
    rows = [(None if name == 0 else name, sorted(set(words)), base) for name, words, base in rows] + [("only", ["all"], False), ("i", [], False), ("i", [], True)]
    lines = spark.createDataFrame(rows, "index_name string, words array<string>, base boolean")
    target, base = lines.where("not base"), lines.where("base")
    asked = target.select("index_name", "words").distinct()
    known = base.select("index_name", "words").where(F.size("words") > 0).distinct()
    got = [(r.index_name, tuple(r.words), round(r.distance, 9)) for r in scoring.by_blocks(asked, known, 4, 3).collect()]

    def nearest(name, words):
        best = [len(set(words) & set(b)) / math.sqrt(len(words) * len(b)) for n, b, is_base in rows if is_base and n == name and b and words]
        return round(max(0.0, 1 - max(best, default=0.0)), 9)

    want = {(name, tuple(words), nearest(name, words)) for name, words, is_base in rows if not is_base}
    assert len(got) == len(want) and set(got) == want


def test_fresh_errors_on_tokens(spark):
    got = registry.queries()["fresh_errors_tokens"](spark, SF).collect()
    lines = {hashlib.md5(r.line.encode()).hexdigest() for r in registry._event_lines(spark, SF).select("line").collect()}
    assert got and not lines & {r.line for r in got}  # what is told has the words that no line of the others has


def test_paths(spark):
    names = {"titi/current/log": "titi/log", "galera/logs/service.txt": "galera/service", "log": "log"}
    rows = spark.createDataFrame([(k,) for k in names], "p string").select("p", paths.index_name(F.col("p")).alias("n"), paths.file_format(F.lit("a.journal~")).alias("f")).collect()
    assert {r.p: r.n for r in rows} == names
    assert rows[0].f == "journal"


def test_timestamps(spark):
    lines = {"2024-01-02 03:04:05,678 x": 1704164645678, "2024-01-02T03:04:05Z x": 1704164645000, "[2024/01/02 03:04:05] x": 1704164645000, " 2024-01-02 03:04:05": None, "none": None}
    got = spark.createDataFrame([(k,) for k in lines], "l string").select("l", times.full_timestamp(F.col("l")).alias("t")).collect()
    assert {r.l: r.t for r in got} == lines


def test_archives(spark, tmp_path):
    (tmp_path / "plain.log").write_text("one\n\ntwo\n")
    (tmp_path / "zipped.log.gz").write_bytes(gzip.compress(b"three"))
    (tmp_path / "bad.log.gz").write_bytes(b"no gzip")
    (tmp_path / "skipped.png").write_text("x")
    with tarfile.open(tmp_path / "all.tar", "w") as tar:
        tar.add(tmp_path / "plain.log", "inner/plain.log")
    got = archives.read_lines(spark, str(tmp_path)).collect()
    assert sorted((r.pos, r.line) for r in got if not r.error) == [(1, "one"), (1, "one"), (1, "three"), (3, "two"), (3, "two")]
    assert [r.path.endswith("bad.log.gz") for r in got if r.error] == [True]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("i", "known line here"), ("i", "something else entirely")], "index_name string, line string")
    rows.write.json(str(tmp_path / "in"))
    base = spark.createDataFrame([("i", ["here", "known", "line"])], "index_name string, words array<string>")
    score_stream(spark.readStream.schema(rows.schema).json(str(tmp_path / "in")), base, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.line for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["something else entirely"]


def _tables(spark, folder, rows):
    """Documents of (lang, source, doc_id, text) as a table of its own."""
    spark.createDataFrame(rows, "lang string, source string, doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_context_windows(spark, tmp_path):
    known = [f"step {k} of the work is done" for k in range(40)]
    text = [*known[:13], "the disk burns badly", *known[13:15], "a fan stopped spinning", *known[15:30], "last words unheard"]
    rows = [("en", "src1", 1, "\n".join(known)), ("en", "src9", 2, "\n".join(text))]
    got = {r.pos: (r.before, r.after) for r in registry.queries()["context_windows"](spark, _tables(spark, tmp_path, rows)).collect()}

    def said(lines):
        return ",".join(hashlib.md5(x.encode()).hexdigest() for x in lines)

    sets = [set(x.split()) for x in known]
    far = [k for k, x in enumerate(text) if max(len(s & set(x.split())) / math.sqrt(len(s) * len(set(x.split()))) for s in sets) < 0.7]
    assert [text[k] for k in far] == ["the disk burns badly", "a fan stopped spinning", "last words unheard"]
    assert got == {14: (said(text[10:13]), said(text[14:16])), 17: ("", said(text[17:20])), 33: (said(text[29:32]), "")}


def test_report_on_tokens(spark, tmp_path):
    known = [f"connect from client number {k} with session closed" for k in range(5)] + ["service started normally without warnings", "noise"]
    text = ["connect from client number 77 with session closed", "service started normally without warnings", "kernel panic happened suddenly at 12", "noise", "kernel panic happened suddenly at 99", "single"]
    rows = [("en", "src1", 1, "\n".join(known)), ("en", "src7", 2, "\n".join(text)), ("en", "src8", 3, "\n".join(text)), ("fr", "src8", 4, text[2])]

    def key(line):
        return tuple(sorted(w for w in tokenizer.tokenize(line).split(" ") if not w.startswith("%")))

    def sets(lines):
        first = {}
        for x in lines:
            first.setdefault(key(x), {w for w in tokenizer.tokenize(x).split(" ") if w})
        return first

    base, want, reported = sets(known), [], set()
    for index, parts in (("en", rows[1:3]), ("fr", rows[3:])):
        seen = set()
        for _, source, doc, body in parts:
            for pos, x in enumerate(body.split("\n"), 1):
                if key(x) in seen:
                    continue
                seen.add(key(x))
                words = sets([x])[key(x)]
                near = max((len(words & b) / math.sqrt(len(words) * len(b)) for b in base.values() if words and b), default=0)
                if 1 - near > 0.3 and key(x) not in reported:
                    reported.add(key(x))
                    want.append((index, f"{source}/doc-{doc}.log", pos, round(1 - near, 6)))
    got = registry.queries()["report_lines_tokens"](spark, _tables(spark, tmp_path, rows)).collect()
    assert sorted((r.index_name, r.source, r.pos, r.distance) for r in got) == sorted(want)
    assert [r[1:3] for r in want] == [("src7/doc-2.log", 3)]
    assert (got[0].before.count(",") + 1, got[0].after.count(",") + 1) == (2, 3)

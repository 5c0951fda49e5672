import math
import random

import pytest
from pyspark.sql import functions as F

from driftline import catalog
from driftline.functions import config
from driftline.operators import known, reports, scoring, similarity
from driftline.sinks import store

SCHEMA = "index_name string, source string, seq long, pos long, line string"


def _lines(spark, sources):
    rows = [(index, source, k, k, x) for index, source, lines in sources for k, x in enumerate(lines, 1)]
    return spark.createDataFrame(rows, SCHEMA)


KNOWN = [f"step number {'abcdefghij'[k]} of the work is finished" for k in range(10)]


def test_contexts_in_blocks_equal_one_window(spark):
    rng = random.Random(3)
    rows = [(s, k, f"l{k}", rng.random() < 0.2, rng.random() < 0.7, k if rng.random() < 0.1 else None) for s in "ab" for k in range(1, 300)]
    df = spark.createDataFrame(rows, "source string, pos long, line string, anomaly boolean, kept boolean, stamp long").withColumn("seq", F.col("pos"))
    want = {}
    for s in "ab":
        own = [r for r in rows if r[0] == s]
        end = last = 0
        for k, r in enumerate(own, 1):
            if r[3] and r[4]:
                nxt = next((j for j in range(k + 1, len(own) + 1) if own[j - 1][3]), 10**9)
                gap = k - 1 - end
                before = [own[j - 1][2] for j in range(k - (gap if gap < 12 else 3), k)]
                until = min(k + 3, nxt - 1, len(own))
                stamp = next((own[j - 1][5] for j in range(k, max(last, k - 34), -1) if own[j - 1][5] is not None), None)
                want[s, k] = (before, [own[j - 1][2] for j in range(k + 1, until + 1)], stamp)
                end, last = max(end, min(k + 3, nxt - 1)), k
    for block in (64, 4096):
        got = {(r.source, r.pos): (r.before, r.after, r.stamp_near) for r in scoring.contexts(df, by=("source",), block=block).collect()}
        assert got == want


def test_report(spark, tmp_path):
    base = _lines(spark, [("api", "/b/api.log", KNOWN), ("net", "/b/net.log", ["link is going up again soon"])])
    target = _lines(spark, [
        ("api", "/t/api.log", [*KNOWN[:3], "2024-01-01 00:00:05,250 the disk burns badly today", "ignore this burning thing", *KNOWN[3:6], "TASK [marker", "all fans stopped spinning now"]),
        ("net", "/t/job-output.txt", ["link is going up again soon", "00:00:00 the disk burns badly today", "I0101 00:00:07.125000 strange packets arrived here", "TASK [marker", "never seen this before at all"]),
        ("new", "/t/new.log", ["whatever stands in here"]),
    ])
    setting = config.TargetConfig(ignore_patterns=["^ignore"])
    model = reports.train(base, setting)
    out = reports.report(target, model, setting, marker="TASK [marker")
    got = {(r.source, r.pos): r for r in out.anomalies.collect()}
    assert sorted(got) == [("/t/api.log", 4), ("/t/api.log", 9), ("/t/api.log", 10), ("/t/job-output.txt", 3)]
    assert got["/t/api.log", 4].after == KNOWN[3:6] and got["/t/api.log", 4].before == KNOWN[:3]
    assert got["/t/api.log", 4].ts_ms == 1704067205250 and got["/t/job-output.txt", 3].ts_ms == 1704067207125
    assert [r.source for r in out.unknown_files.collect()] == ["/t/new.log"]
    assert [r.source for r in out.log_reports.orderBy(F.desc("sort"), "source").collect()] == ["/t/job-output.txt", "/t/api.log"]
    assert out.totals.first() == (12, 4)
    store.save_report(out, str(tmp_path / "r"))
    assert store.load_report(spark, str(tmp_path / "r")).anomalies.count() == 4
    assert [r.source for r in reports.timeline(out.anomalies).collect()][:2] == ["/t/api.log", "/t/job-output.txt"]
    assert store.as_text(out.anomalies).where("seq = 3").first().text.split("\n")[-1].endswith("strange packets arrived here")
    everything = reports.score(target, model, config.TargetConfig(skip_duplicate=False))
    assert everything.where("kept").count() > 4


def test_single_index_stands_for_all(spark):
    model = reports.train(_lines(spark, [("api", "b", KNOWN)]))
    found = reports.score(_lines(spark, [("other", "t", [KNOWN[0], "the disk burns badly today"])]), model)
    assert [r.anomaly for r in found.orderBy("seq").collect()] == [False, True]


def test_models(spark, tmp_path):
    a, b = (reports.train(_lines(spark, [("api", s, x)])) for s, x in (("1", ["first line here", "second line here"]), ("2", ["first line here", "third line here"])))
    both = reports.merge(a, b)
    assert both.rows.count() == 3
    assert both.meta.select("line_count", "samples", "sources").first() == (4, 3, ["1", "2"])
    assert reports.merge(both, both).rows.count() == 3
    store.save_model(both, str(tmp_path / "m"), 17)
    assert store.check_model(spark, str(tmp_path / "m")) == 17
    assert store.load_model(spark, str(tmp_path / "m")).rows.count() == 3
    with pytest.raises(store.BadModel):
        store.check_model(spark, str(tmp_path / "none"))
    spark.createDataFrame([('{"magic": "DRFT", "version": 0}',)], "value string").write.text(str(tmp_path / "old" / "_meta_model"))
    with pytest.raises(store.BadModel):
        store.load_model(spark, str(tmp_path / "old"))


TASKS = """2025-10-22 10:02:43.255665 | TASK [First manager check]
2025-10-22 10:02:43.304194 | primary | ERROR
2025-10-22 10:02:43.304485 | primary | {
nop
nop
2025-10-23 10:02:43.255665 | TASK [Second task]
2025-10-23 10:02:43.304194 | primary | ERROR
2025-10-23 10:02:43.304485 | primary | {""".split("\n")


def test_known_errors_of_job_outputs_look_at_the_lines_before(spark):
    target, base = (_lines(spark, [("job", "logs/job-output.txt", x)]) for x in (TASKS, TASKS[:3]))
    found = known.errors_report(target).orderBy("pos").collect()
    assert [(r.pos, r.before, r.after, r.ts_ms, r.distance) for r in found] == [
        (2, [TASKS[0]], [TASKS[2], "nop", "nop"], 1761127363304, 0.5),
        (7, [TASKS[5]], [TASKS[7]], 1761213763304, 0.5),
    ]
    assert [r.pos for r in known.report_errors(target, base).collect()] == [7]
    # of another index nothing is known
    assert known.report_errors(target.withColumn("index_name", F.lit("x")), base).count() == 2


def test_similarity(spark):
    rows = [(0, "i", "a", 1, "x"), (0, "i", "b", 1, "x"), (0, "i", "a", 2, "y"), (1, "i", "c", 5, "x"), (2, "i", "d", 1, "y"), (2, "i", "d", 2, "z"), (1, "j", "e", 1, "x")]
    df = spark.createDataFrame([(*r, r[4]) for r in rows], "target int, index_name string, source string, pos long, tokens string, line string")
    found = similarity.shared(df)
    got = {(r.index_name, r.tokens): [tuple(h) for h in r.holders] for r in found.collect()}
    assert got == {("i", "x"): [(0, "a"), (1, "c")], ("i", "y"): [(0, "a"), (2, "d")], ("i", "z"): [(2, "d")], ("j", "x"): [(1, "e")]}
    assert {(r.t1, r.t2): (r.shared, r.percent) for r in similarity.percents(found).collect()} == {(0, 1): (1, 50.0), (0, 2): (1, 50.0)}
    assert [r.line for r in similarity.top(found, n=2).collect()] == ["x", "y"]
    assert [tuple(r) for r in similarity.similarity_reports(df).collect()] == [("i", 4, 3), ("j", 1, 1)]
    assert {r.source: r.source_id for r in similarity.sources(df).where("index_name = 'i'").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_distances_are_bounded_and_zero_to_themselves(spark):
    rng = random.Random(5)
    sets = [sorted({f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 9))}) for _ in range(60)]
    df = spark.createDataFrame([("i", s) for s in sets], "index_name string, words array<string>")
    got = scoring.distances(df, df.limit(30)).collect()
    assert all(0 <= r.distance <= 1 for r in got)
    for r in got:
        want = min(1 - len(set(r.words) & set(b)) / math.sqrt(len(r.words) * len(b)) for b in sets[:30])
        assert math.isclose(r.distance, max(0, want), abs_tol=1e-9)


def test_catalog(spark, tmp_path):
    held = catalog.Catalog(spark, str(tmp_path))
    one, two = held.initialize("t", "b"), held.initialize("t", "b", errors=True)
    assert (one, two) == (1, 2)
    held.update(one, 7, "completed", 100)
    assert held.status(one) == "completed" and held.status(two) == "pending" and held.status(9) is None
    assert [r.id for r in catalog.without_pending(held.reports).collect()] == [1]
    assert catalog.lookup_report(held.reports, "t", "b", False).first() == (1, "completed")
    assert [r.id for r in catalog.newest(held.reports).collect()] == [2, 1]
    held.add_model("File(x)", 40)
    held.add_model("File(x)", 60, errors=True)  # beside the other, not in its place
    assert catalog.current_models(held.models).count() == 2
    assert catalog.bytes_used(catalog.latest(held.reports, "id"), held.models).first()[0] == 200
    with pytest.raises(KeyError):
        held.update(99, 0, "x", 0)


def test_command_line_and_evaluation(spark, tmp_path, capsys):
    from driftline import cli, evaluate

    for name, extra in (("base", []), ("target", ["the disk burns badly today"])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "api.log").write_text("\n".join([*KNOWN, *extra]))
    base, target = str(tmp_path / "base"), str(tmp_path / "target")
    cli.main(["diff", target, "--baselines", base, "--model", str(tmp_path / "m")], spark)
    assert "the disk burns badly today" in capsys.readouterr().out
    cli.main(["diff", target, "--model", str(tmp_path / "m"), "--report", str(tmp_path / "r")], spark)
    assert store.load_report(spark, str(tmp_path / "r")).totals.first().anomaly_count == 1
    cli.main(["filter-report", str(tmp_path / "f"), str(tmp_path / "r"), str(tmp_path / "r")], spark)
    assert spark.read.parquet(str(tmp_path / "f")).count() == 0
    cli.main(["debug", "tokenizer", "Test Fail"], spark)
    assert "Fail%A" in capsys.readouterr().out
    (tmp_path / "case").mkdir()
    (tmp_path / "case" / "inf.yaml").write_text("anomalies:\n  - line: disk burns\n")
    (tmp_path / "case" / "a.good").write_text("\n".join(KNOWN))
    (tmp_path / "case" / "a.fail").write_text("\n".join([*KNOWN, "the disk burns badly today"]))
    assert evaluate.case(spark, str(tmp_path / "case")) == []

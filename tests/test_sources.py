import io
import lzma
import struct
import tarfile

import pytest
import zstandard
from pyspark.sql import functions as F

from driftline.functions import ci, config, urls
from driftline.sources import archives, generate, inputs, journal, web


def _journal(entries, compact=False, pack=None):
    """A journal file of (micros, {name: value}); pack compresses data objects (flag, function)."""
    body, objects = b"", {}
    start = 208

    def add(kind, flags, payload):
        nonlocal body
        at = start + len(body)
        raw = bytes([kind, flags]) + b"\0" * 6 + struct.pack("<Q", 16 + len(payload)) + payload
        body += raw + b"\0" * (-len(raw) % 8)
        return at

    for when, fields in entries:
        refs = []
        for name, value in fields.items():
            data = f"{name}={value}".encode()
            if (name, value) not in objects:
                flag, f = pack if pack else (0, bytes)
                objects[name, value] = add(1, flag, b"\0" * (56 if compact else 48) + f(data))
            refs.append(objects[name, value])
        items = b"".join(struct.pack("<I", r) if compact else struct.pack("<QQ", r, 0) for r in refs)
        add(2, 0, b"skip me")
        add(3, 0, struct.pack("<QQQ", 1, when, 0) + b"\0" * 24 + items)
    head = bytearray(start)
    head[:8] = b"LPKSHHRH"
    struct.pack_into("<I", head, 12, 16 if compact else 0)
    struct.pack_into("<QQ", head, 88, start, len(body))
    return bytes(head) + body


ENTRIES = [(1_700_000_000_123_456, {"MESSAGE": "one\ntwo\n", "SYSLOG_IDENTIFIER": "svc", "X": "y"}), (1_700_000_001_000_000, {"MESSAGE": "three", "_COMM": "cmd"}), (1_700_000_002_000_000, {"MESSAGE": "nobody"}), (1_700_000_003_000_000, {"MESSAGE": "three", "_COMM": "cmd"})]


@pytest.mark.parametrize("compact", [False, True])
@pytest.mark.parametrize("pack", [None, (4, zstandard.ZstdCompressor().compress), (1, lzma.compress)])
def test_journal(compact, pack):
    raw = _journal(ENTRIES, compact, pack)
    want = [(1, "2023-11-14 22:13:20,123 - svc: one"), (2, " " * 31 + "two"), (3, "2023-11-14 22:13:21,000 - cmd: three"), (5, "2023-11-14 22:13:23,000 - cmd: three")]
    got = list(journal.lines(io.BytesIO(raw)))
    assert [x[1].strip() for x in got] == [x[1].strip() for x in want] and [x[0] for x in got] == [x[0] for x in want]
    assert got[1][1] == " " * len("2023-11-14 22:13:20,123 - svc: ") + "two"
    assert len(list(journal.lines(io.BytesIO(raw[:-9])))) == 3  # a torn end


def test_journal_bad():
    with pytest.raises(journal.JournalError):
        list(journal.lines(io.BytesIO(b"no journal" * 30)))


def test_read_lines_by_format_and_configuration(spark, tmp_path):
    (tmp_path / "a.journal").write_bytes(_journal(ENTRIES))
    (tmp_path / "b.json").write_text('{"k": [1, 2]}')
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "c.log.xz").write_bytes(lzma.compress(b"cc"))
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w:gz") as tar:
        for name in ("deep/x.log", "deep/y.png"):
            data = tarfile.TarInfo(name)
            data.size = 4
            tar.addfile(data, io.BytesIO(b"deep"))
    with tarfile.open(tmp_path / "all.tar", "w") as tar:
        data = tarfile.TarInfo("in/inner.tar.gz")
        data.size = len(inner.getvalue())
        tar.addfile(data, io.BytesIO(inner.getvalue()))
    got = archives.read_lines(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r.path.rsplit("/", 1)[1] if "?" not in r.path else r.path.split("?")[1], []).append(r.line)
    assert len(by["a.journal"]) == 4 and by["c.log.xz"] == ["cc"] and by["b.json"] == ['"k": ', "1", " 2"]
    assert by["entry=in/inner.tar.gz&sub=deep/x.log"] == ["deep"] and len(by) == 4
    only = archives.read_lines(spark, str(tmp_path), config.TargetConfig(includes=["c.log"]))
    assert {r.path.rsplit("/", 1)[1] for r in only.collect()} == {"c.log.xz"}
    assert archives.groups(archives.log_lines(only)).first().n_sources == 1


PAGES = {
    "http://h/job/": '<a href="../">..</a><a href="./a.log">a</a><a href="sub/">s</a><a href="/etc/passwd">p</a><a href="http://other/x">o</a><h3>Logs of interest</h3><a href="late.log">l</a>',
    "http://h/job/sub/": '<a href="b.log">b</a><a href="/job/">up</a><a href="sub2/index.html">i</a><a href="missing/">m</a>',
    "http://h/job/sub/sub2/": '<a href="c.log">c</a>',
}


def test_crawl():
    want = {"http://h/job/a.log", "http://h/job/sub/b.log", "http://h/job/sub/sub2/c.log"}
    assert set(web.crawl("http://h/job/", PAGES.get)) == want
    assert set(web.crawl("http://h/job/", PAGES.get, most_requests=1)) == {"http://h/job/a.log", "http://h/job/sub/b.log"}
    with pytest.raises(web.ListingError):
        list(web.crawl("http://nothing/", PAGES.get))
    assert set(web.build_sources("http://h/job/", "http://h/manifest", PAGES.get)) == want
    manifest = '{"tree": [{"name": "x.log", "mimetype": "text/plain"}, {"name": "y.png", "mimetype": "image/png"}]}'
    assert web.build_sources("http://h/job/", "m", {"m": manifest}.get) == ["http://h/job/x.log"]


def test_index_links_column_equals_driver(spark):
    rows = spark.createDataFrame(list(PAGES.items()), "u string, p string").select("u", urls.index_links(F.col("u"), F.col("p")).alias("l")).collect()
    assert {r.u: r.l for r in rows} == {u: web.index_links(u, p) for u, p in PAGES.items()}


def test_job_history():
    pages = {"https://s/job-history/gs/b/pr-logs/directory/j": 'x\n  var allBuilds = [{"ID": "2"}, {"ID": "1"}];\n', "https://s/job-history/gs/b/pr-logs/directory/j?buildId=1": "var allBuilds = [];"}
    assert [b["ID"] for b in web.job_history("j", ("gs", "b"), pages.get, "https://s")] == ["2", "1"]


def test_download(tmp_path):
    got = web.download(["http://h/a/x.log", "http://h/a/d/y.log"], "http://h/a/", str(tmp_path), lambda u: u.encode())
    assert [open(p).read() for p in got] == ["http://h/a/x.log", "http://h/a/d/y.log"]
    with pytest.raises(ValueError, match="leaves"):
        web.download(["http://h/a/../../x"], "http://h/a/", str(tmp_path), lambda u: b"")


def test_inputs(tmp_path):
    (tmp_path / "f.log").write_text("x")
    (tmp_path / "f.log.0").write_text("x")
    uid = "0123456789abcdef0123456789abcdef"
    assert [inputs.of_input(str(p)).kind for p in (tmp_path, tmp_path / "f.log")] == ["directory", "file"]
    assert inputs.of_url(f"https://z/t/ten/build/{uid}") == inputs.Content("ci", f"https://z/t/ten/build/{uid}", "https://z/api/tenant/ten/", uid)
    assert inputs.of_url(f"https://z/build/{uid}").api == "https://z/api/"
    assert inputs.of_url("https://prow.ci.openshift.org/view/gs/b/pr-logs/pull/o_r/437/pull-job/1689").job_name == "pull-job"
    assert [inputs.of_url(u).kind for u in ("https://x/a/", "https://x/a.log")] == ["directory", "file"]
    assert inputs.baselines(inputs.of_path(str(tmp_path / "f.log")))[0].where.endswith("f.log.0")
    with pytest.raises(FileNotFoundError):
        inputs.of_path(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="only builds"):
        inputs.for_service(inputs.of_url("https://x/a/"))


def test_config(spark):
    def check(text, path, job=None):
        target = config.parse(text).target(job)
        return spark.range(1).select(target.included(F.lit(path))).first()[0]

    assert [check("", p) for p in ("service/api.log", "job-output.txt", "config.yaml", "/config/.git/HEAD", "font.ttf.gz", "/system/etc/conf", "a/sos_commands/selinux/ps_auxZww")] == [True, True, False, False, False, False, False]
    inc = "includes:\n  - undercloud/deploy.log\n"
    assert [check(inc, p) for p in ("service/api.log", "undercloud/deploy.log", "undercloud/deploy.log.log", "undercloud/deploy.log.png")] == [False, True, True, False]
    none = "default_excludes: false\nexcludes:\n  - bzImage\n"
    assert [check(none, p) for p in ("test.png", "/.git/config", "boot/bzImage")] == [True, True, False]
    for bad, name in (("unknown: true", "c.yaml"), ('{"unknown": true}', "c.json"), ("- match: x", "c.yaml")):
        with pytest.raises(config.ConfigError):
            config.parse(bad, name)
    jobs = config.parse("- match_job: config-.*\n  config: {}\n- match_job: linters\n  config:\n    ignore_patterns:\n    - fetch log\n")
    assert [jobs.index_for(j) for j in ("proj-linters", "config-check", "unit", None)] == [1, 0, None, 0]
    assert jobs.target("linters").ignore_patterns == ["fetch log"] and jobs.target("unit") == config.TargetConfig()


def test_manifest_and_inventory():
    tree = '{"tree": [{"name": "d", "mimetype": "application/directory", "children": [{"name": "a b", "mimetype": "text/plain"}]}]}'
    assert ci.flatten_manifest(tree, "http://l") == ["http://l/d/a%20b"]
    zuul = {"tenant": "t", "build": "b", "job": "j", "project": {"name": "p"}, "branch": "m", "pipeline": "check", "change_url": "http://c"}
    assert ci.from_inventory({"all": {"vars": {"zuul": zuul}}}, "https://z/")["log_url"] == "https://z/api/tenant/t/build/b"


def test_generated_lines(spark):
    rows = generate.lines(spark, 50).collect()
    assert all(2 <= len(r.line.split(" ")) <= 9 and all(2 <= len(w) <= 17 and w.isalnum() for w in r.line.split(" ")) for r in rows)
    assert sorted(rows) == sorted(generate.lines(spark, 50).repartition(7).collect())

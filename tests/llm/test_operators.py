import hashlib
import random
import re
import textwrap
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import decontaminate, html_extract, licenses, line_dedup, near_dup, packing, pii, quality, substring_dup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


A, B, C = " ".join(_words("a", 80)), " ".join(_words("b", 90)), "line one x\nline two x\nline three x\nline four x"
TEXTS = [None, "", "one two", "one two", A, A, A.replace("a40 ", "zz "), B, B + " " + A, "x " * 200, C, C + "\nfifth y", "ß é " * 3000, A.upper(), "a1 a2 a3 a4"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i + 10, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup_equals_sql(docs, empty):
    con = duckdb.connect()
    table = docs.toPandas()
    con.register("documents", table)
    got = sorted(map(tuple, line_dedup.digests(line_dedup.line_dedup(docs)).collect()))
    assert got == sorted(con.sql(line_dedup.ORACLE).fetchall())
    assert line_dedup.line_dedup(empty).count() == 0
    clash = docs.selectExpr("*", "1 as n_removed", "2 as extra")
    assert line_dedup.line_dedup(clash).where("doc_id = 21").select("text", "extra", "n_removed").first() == ("fifth y", 2, 4)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(14, 1, 0), (17, 1, 0), (19, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for n in (1, 2):
        got = {r.doc_id: r for r in quality.quality_rules(docs, labels, n=n, prior=1.0).collect()}
        for i, t in enumerate(TEXTS):
            w, r = WORD.findall(t or ""), got[i + 10]
            c = Counter(zip(w, w[1:], w[2:], strict=False))
            again = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
            lines = [x for x in (t or "").split("\n") if WORD.search(x)]
            assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
            assert r.base_failed == (len(w) < 50 or 2 * len(again) > len(w))
        assert got[14].kept and got[14].score > 0 and not got[19].kept
    assert quality.quality_rules(empty, labels).count() == 0
    assert all(r.score == 0 for r in quality.quality_rules(docs, labels.limit(0)).collect())


def _shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, empty):
    sets = {i + 10: _shingles(t) for i, t in enumerate(TEXTS)}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}
    assert near_dup.near_duplicates(empty).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    bins = near_dup.sketch([base[:800], base[100:], base[:3]], 2000)
    assert (bins != np.iinfo(np.uint64).max).all()
    assert abs((bins[0] == bins[1]).mean() - 700 / 900) < 0.05


@pytest.mark.parametrize("block", [1, 512])
def test_crossing_blocks_lose_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    chain = [" ".join(_words("w", 200)[k : k + 120]) for k in range(0, 60, 4)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(chain)], "doc_id long, text string")
    assert {r.component_id for r in near_dup.near_duplicates(df).collect()} == {0}


def test_packing_round_trip(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, window=256).collect()
    for i, t in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == i + 10), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in own]).tolist()
        assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
    for s in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) <= 256
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("word", ["<|endoftext|>.", "Été,", "don't.", "x1.", "ＡＢＣ", "é́", "...", "İ.", "ſt;"])
def test_encoder_words(word):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = np.frombuffer(packing.encoder(path)(f"a {word} b".encode()), "<u4").tolist()
    assert got == Tokenizer.from_file(path).encode(f"a {word} b", add_special_tokens=False).ids


def test_nnls():
    a = np.array([[1.0, 0, 2], [0, 1, 1], [1, 1, 0]])
    x = np.array([2.0, 0, 3])
    assert np.allclose(packing.nnls(a, a @ x), x)
    assert (packing.nnls(a, np.array([1.0, -5, 1])) >= 0).all()


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(docs, empty, batches):
    words = {i + 10: WORD.findall(t or "") for i, t in enumerate(TEXTS)}
    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    got = {r.doc_id: tuple(r)[1:] for r in substring_dup.digests(substring_dup.substring_dedup(docs, batches=batches)).collect()}
    for i, w in words.items():
        gone = {k + d for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for d in range(35)}
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    assert substring_dup.substring_dedup(empty).count() == 0


def test_html(spark):
    def page(k, body):
        return f"<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><div>Welcome to the site</div>{body}<div>Written by the staff</div><div class='ad box'>buy {k}</div><footer>end</footer></body></html>"

    rows = [(i, f"http://h.example/{i}", page(i, f"<div><p>text &amp; {i}<br>more  {i}</div>")) for i in range(6)]
    rows += [(90, None, None), (91, "http://other.example/", page(0, "<article><h1>A</h1><p>b <b>c</b> d<p>e<div class=comments>no</div></article>")), (92, "x", ""), (93, "http://deep.example/", "<div>" * 3000 + "deep")]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == [f"text & {i}\nmore {i}" for i in range(6)]
    assert (got[90], got[91], got[92], got[93]) == ("", "A\nb c d\ne", "", "deep")


def test_html_references_joined(spark):
    df = spark.createDataFrame([(i, "http://h/x", f"<p>same<p>{i}") for i in range(5)], "page_id long, url string, html string")
    small, large = (sorted(map(tuple, html_extract.main_text(df, most_reference_chars=m).collect())) for m in (10**6, 0))
    assert small == large and [t for _, _, t in small] == [str(i) for i in range(5)]


def test_html_template_without_reference(spark):
    words = lambda k: f"<p>text {k}<p>more {k * 7}"
    rows = [(0, "")]  # an empty page comes first
    rows += [(i, f"<p>old {i}") for i in range(1, 3)]  # boilerplate is not on the first pages
    rows += [(i, f"<div>Welcome {i % 3}</div>{words(i)}<div>End {i % 3}</div>") for i in range(3, 30)]  # three layouts
    flat = [(100 + i, "".join(f"<p>w{i} {j}" for j in range(66 + i)) + "<p>The end") for i in range(5)]  # more than 65 x 65 children
    deep = [(200 + i, "<div>" * 500 + f"deep {i}</div><p>Bye") for i in range(5)]
    df = [(i, "http://h/x", t) for i, t in rows] + [(i, "http://flat/x", t) for i, t in flat] + [(i, "http://deep/x", t) for i, t in deep]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(df, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text {i}\nmore {i * 7}" for i in range(3, 30))
    assert all("The end" not in got[100 + i] and got[100 + i].count("\n") == 65 + i for i in range(5))
    assert all(got[200 + i] == f"deep {i}" for i in range(5))


def test_licenses(spark, docs, empty):
    rows = [(1, "Text. Released under the MIT License."), (2, "é\nLicensed under CC BY-NC 4.0.\nmore"), (3, "You need a license to drive a car in most countries of the world."), (4, None)]
    got = {(r.doc_id, r.start, r.end, r.license, r.n_different) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 6, 37, "MIT", 0), (2, 2, 30, "CC-BY-NC-4.0", 0)}
    assert licenses.licenses(empty).count() == 0 == licenses.licenses(docs).count()


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_licenses_wrapped_and_embedded(mark):
    for name in ("MIT", "GPL-3.0", "AGPL-3.0"):
        lines = ["int x = 1;", *(mark + x for x in textwrap.wrap(licenses.TEMPLATES[name][1], 72)), "return x"]
        assert [r[2] for r in licenses.notices("\n".join(lines))] == [name]
    inside = "x y z " * 900 + "the code is Released under the MIT License and so on " + "x y z " * 900
    start = inside.index("Released")
    assert [r[:3] for r in licenses.notices(inside)] == [(start, start + 30, "MIT")]


def test_licenses_name_and_version_veto():
    said = {
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"],
        "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
        "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0"],
        "Licensed under CC BY-ND 2.5.": [],
        "Released under the ISC License.": [],
        "Released under the BSD 4-Clause License.": [],
        "This work is licensed under the GNU General Public License, version 1.": [],
    }
    assert {t: [r[2] for r in licenses.notices(t)] for t in said} == said


def test_pii(spark, empty):
    texts = ["mail a.b@c.d.e now", "ip 1.2.3.4.5.6.7.8 and 300.1.1.1", "4111 1111 1111 1111 or 4111 1111 1111 1112", "+1 (743) 555-3824 +12", "é 😀 x@y.zz_q@w.ee", None, "1" * 50_000, "@" * 5000 + "+" * 5000]
    got = {r.doc_id: r for r in pii.digests(pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert [got[i].spans for i in range(8)] == ["email:5:14", "ip:3:10,ip:11:18", "card:0:19", "phone:0:17", "email:4:10,email:10:17", "", "", ""]
    assert pii.personal_data(empty).count() == 0


def test_pii_disclosing_term(spark):
    rows = [(i, f"{'abcd'[i]}xx wrote that Zanzibarov ann@mail.example answered {'efgh'[i]}yy today") for i in range(4)] + [(9 + i, "that was answered today wrote") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.personal_data(df)
    found = {r.doc_id: [(t.s, t.e) for t in r.terms] for r in spans.collect()}
    assert all(found[i] == [(15, 25)] for i in range(4)) and not found[9]
    clean = {r.doc_id: r.text for r in pii.sanitise(df, spans).collect()}
    assert clean[0] == "axx wrote that  [EMAIL] answered eyy today"


def test_pii_once_seen_entities(spark):
    filler = [f"some plain words about thing number {i}" for i in range(1200)]
    rows = ["Zanzibarov " + "plain words " * 30 + "ann@one.example some words"]  # far from its address, both once
    rows += [f"words about Quuxcorp some thing {k} {'abcdefghjk'[k]}@quux.example number plain" for k in range(10)]
    rows += ["plain words bob@two.example about thing", "nothing but plain words of Quuxcorp"]
    got = [[(t.s, t.e) for t in r.terms] for r in pii.personal_data(spark.createDataFrame(list(enumerate(rows + filler)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == [(0, 10)]
    assert all(x == [(12, 20)] for x in got[1:11])
    assert not any(got[11:])


def test_tiling_catches_reordered():
    a = np.arange(20, dtype=np.uint64)
    doc = np.concatenate([[99] * 5, a[10:], [98] * 5, a[:10], [97] * 5]).astype(np.uint64)
    assert sorted(decontaminate.tiles(a, doc, 5)) == [(0, 20, 10), (10, 5, 10)]


def test_decontaminate_both_ways(spark, docs, empty):
    bench = spark.createDataFrame([(1, " ".join(_words("a", 30))), (2, "q r s t u v w"), (3, None), (4, "ONE, two"), (5, "")], "item_id long, text string")
    near, far = (sorted(map(str, decontaminate.contaminated(docs, bench, most_chars=m).collect())) for m in (10**6, 0))
    assert near == far
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(12, 4), (13, 4), (14, 1), (15, 1), (16, 1), (18, 1), (23, 1)}
    assert decontaminate.contaminated(empty, bench).count() == 0 == decontaminate.contaminated(docs, bench.limit(0)).count()


def test_warc(spark):
    rows = [
        (1, "http://www.A.com:80/x/?utm_s=1#f", 10, "response", "d1", {"etag": "e", "server": "s", "date": "1"}),
        (2, "https://a.com/x", 20, "revisit", None, {"etag": "e", "date": "2", "server": "t"}),
        (3, "https://a.com/x", 90_000, "revisit", None, {"etag": "f"}),
        (4, "https://a.com/x", 10, "revisit", None, None),
        (5, "https://a.com/x", 30, "revisit", None, {}),
        (6, None, None, "revisit", None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, digest string, headers map<string,string>")
    got = {r.record_id: (r.state, r.response_id, r.headers) for r in warc.resolve_revisits(df).collect()}
    assert got == {2: ("resolved", 1, {"etag": "e", "server": "s", "date": "2"}), 3: ("changed", None, None), 4: ("orphan", None, None), 5: ("unchecked", 1, {"etag": "e", "server": "s", "date": "1"})}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_places_and_surroundings_in_long_texts(spark):
    """Beyond one block of matches and one part of a text, places and surroundings are those of the plain rule."""
    pieces = ["a😀b", "x1", "1.2.3.4", "me@x.org", "zebra ", "é", "+1 234 567 890 12"]
    rng = random.Random(3)
    texts = [" ".join(rng.choice(pieces) for _ in range(n)) for n in (0, 1, 255, 2000)] + ["me@x.org " * n for n in (pii.BLOCK, pii.BLOCK + 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    text, email = F.col("text"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    for r in docs.select("doc_id", pii.located(text, pii.PATTERNS["email"]).alias("found")).collect():
        assert [(x.s, x.e, x.m) for x in r.found] == [(m.start(), m.end(), m[0]) for m in re.finditer(email, texts[r.doc_id])]
    found = docs.select("text", pii.entities(text).alias("found"))
    for reach in (60, pii.PART + 900):
        lo = lambda x: F.greatest(x["s"] - reach, F.lit(0))
        plain = F.transform("found", lambda x: F.xxhash64(F.substring(text, lo(x) + 1, x["s"] - lo(x)), F.substring(text, x["e"] + 1, F.lit(reach))))
        both = found.select(F.array_distinct(plain).alias("want"), F.array_distinct(pii._occurrences(text, F.col("found"), reach)["place"]).alias("got"))
        assert all(r.want == r.got for r in both.collect())

"""Queries over the log-analytics operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, times, tokenizer, words
from ..functions import patterns as P
from ..operators import errors, scoring, splitting

BASELINE = ("src1", "src2", "src3", "src4", "src5")
_REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        _REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def _all() -> None:
    from . import reporting, services  # noqa: F401  (they register themselves)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return {name: f for name, (f, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    _all()
    return {name: sql for name, (_, sql) in _REGISTERED.items() if sql}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.split_lines(_table(spark, sf, "documents"))


#: Words of every kind, made from an event's number e; the same text in both dialects.
MADE = (
    "'Monday'", "'weeks'", "concat('sha256:', e)", "concat(repeat('a1b2c3d4', 8), e)", "concat('fe80::', e)", "'bcdfg'", "'BCDFG'", "'rabbitmq-cluster-id-q9'",
    "concat('req-', e)", "concat('gAAAAB', e)", "'1a2b3c4d-aaaa-bbbb-cccc-'", "concat('HTTPS://h.example/', e)", "concat('/tmp/x', e)", "concat('tmpdir', e)",
    "concat('refs/changes/', e)", "'abcdefg..1234567'", "concat(e, 'YWJj==')", "concat('QUJDREVGR0hJSktMTU5PUFFS', e)", "concat('svc_unit[', e, ']:')", "'Traceback'",
    "concat('a<b', e)", "concat('v1.', e, '.x')", "'latest'", "concat('0x', e)", "'months'", "'AUTH_token'", "'repos/x'", "concat('md5~', e)",
)
_MADE_SQL = "CASE event_id % " + str(len(MADE)) + " " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(MADE)) + " END"


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of documents and URLs, and made ones of every kind."""
    docs = _table(spark, sf, "documents").select(F.explode(F.split("text", "[ \\n]", -1)).alias("w"))
    urls = _table(spark, sf, "pages").select(F.explode(F.split("url", "/", -1)).alias("w")).union(_table(spark, sf, "pages").select("url"))
    made = _table(spark, sf, "events").withColumn("e", F.col("event_id").cast("string")).select(F.expr(_MADE_SQL).alias("w"))
    return docs.union(urls).union(made).where("w <> ''").distinct()


#: Tails of the lines of error events, by event number: every kind of error line, and some that are none.
TAILS = (
    " ERROR", " ERROR is no end", "|   \"msg\": \"x\"", " task: FAILED!", " | FAILED | rc=1", " | fatal: [h]", " The error appears to be in y", " failed: 3 ", " failed: 0 ", " stderr: 'error: x",
    " |WARN|tcp", " [EC 4]", " [Error] x", " 0 ERROR x", "... FAILED", " %] FAILED x", " ] ERROR: x", " {\"level\":\"ERROR\"}", "   Failed   3", " Warning  Failed  x",
    " E0814 x", " msg=\"error reading file\"", " msg=\"an error occurred\"", " \"level\":\"error\"", " level=error", " an error", " levels=errors",
)


def _event_lines(spark: SparkSession, sf: str) -> DataFrame:
    tails = F.array(*(F.lit(t) for t in TAILS))
    tail = F.when(F.col("event_type") == "error", F.get(tails, (F.col("event_id") % len(TAILS)).cast("int"))).otherwise(F.lit(""))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" INFO svc type="), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" props="), "props", tail)
    return _table(spark, sf, "events").select("event_id", "user_id", "ts", line.alias("line"))


LINES = f"""lines AS (SELECT lang AS index_name, source, doc_id, pos, line FROM (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  WHERE line <> '' AND strlen(line) <= {P.MAX_LINE_BYTES})"""
WORDS = f"""words AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents
  UNION ALL SELECT unnest(string_split(url, '/')) FROM pages UNION ALL SELECT url FROM pages
  UNION ALL SELECT {_MADE_SQL} FROM (SELECT event_id, event_id::VARCHAR AS e FROM events)) WHERE w <> '')"""
_TAILS_SQL = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TAILS) + "]"
EVENTS = f"""event_lines AS (SELECT event_id, user_id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad((extract('milliseconds' FROM ts)::BIGINT % 1000)::VARCHAR, 3, '0') ||
  ' INFO svc type=' || event_type || ' user=' || user_id || ' props=' || props || CASE WHEN event_type = 'error' THEN {_TAILS_SQL}[event_id % {len(TAILS)} + 1] ELSE '' END AS line FROM events)"""
#: Written by hand, not from the constants under test.
IS_ERROR = "regexp_matches(line, '" + "|".join((
    "ERROR [0-9]{4}", "<title>503 Service Unavailable</title>", " ERROR$", "\\|   \"msg\": \"", ": FAILED!", "\\| FAILED \\|", "\\| (fatal|failed|error): ", " The error appears to be in ",
    " failed: [1-9][0-9]*[ \\t]", "stderr: ''error:", "\\|WARN\\|", "\\[EC [0-9]+\\]", " \\[Error\\] ", "[0-9Z][ \\t]+ERROR[ \\t]+[a-zA-Z]", "^FAIL: ", "^(ERROR|FAILED): ", "\\.\\.\\. FAILED$",
    "^<(failure|error) message=", "^E       ", "%\\] FAILED ", "\\] ERROR: ", "\"level\":\"ERROR\"", "[ \\t]{2,}(Failed|Error|CrashLoopBackOff)[ \\t]{2,}[0-9]", "Warning[ \\t]+Failed[ \\t]+",
    "\\bE[0-9]{4}\\b", "msg=\"error", "msg=\"an error", "\"level\":\"error\"", "\\blevel=error\\b",
)) + "')"
_SETS = f"""{LINES}, sets AS (SELECT *, list_sort(list_distinct(list_filter(string_split(line, ' '), lambda w: w <> ''))) AS words FROM lines),
 b AS (SELECT row_number() OVER () AS b, * FROM (SELECT DISTINCT index_name, words FROM sets WHERE source IN {BASELINE} AND len(words) > 0)),
 t AS (SELECT row_number() OVER () AS t, * FROM (SELECT DISTINCT index_name, words FROM sets WHERE source NOT IN {BASELINE})),
 common AS (SELECT t, b, count(*) AS c FROM (SELECT t, index_name, unnest(words) AS w FROM t) JOIN (SELECT b, index_name, unnest(words) AS w FROM b) USING (index_name, w) GROUP BY t, b),
 best AS (SELECT t, max(c / sqrt(len(t.words)::DOUBLE * len(b.words))) AS s FROM common JOIN t USING (t) JOIN b USING (b) GROUP BY t),
 scored AS (SELECT t.index_name, t.words, greatest(0.0, 1 - coalesce(s, 0)) AS distance FROM t LEFT JOIN best USING (t))"""


def _scored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Target lines with words, and t1, t2 to join them by; (t1, t2, distance) of each distinct set."""
    lines = _lines(spark, sf).withColumn("words", scoring.word_set(F.col("line")))
    known = F.col("source").isin(*BASELINE)
    target = lines.where(~known)
    return target.select("*", *scoring.set_ids()), scoring.nearest(target, scoring.Known(lines.where(known)))


def _per_source(spark: SparkSession, sf: str) -> DataFrame:
    """(source, n, distance): how many target lines of a source have each distinct set."""
    target, scored = _scored(spark, sf)
    return target.groupBy("source", "t1", "t2").agg(F.count("*").alias("n")).join(scored, ["t1", "t2"])


@query(f"WITH {_SETS} SELECT source, count(*) AS n_lines, count(*) FILTER (WHERE distance > 0.3) AS n_anomalies FROM sets JOIN scored USING (index_name, words) WHERE source NOT IN {BASELINE} GROUP BY source")
def anomaly_source_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each target source, and those farther than the threshold from every baseline line."""
    hit = F.col("distance") > P.THRESHOLD
    return _per_source(spark, sf).groupBy("source").agg(F.sum("n").alias("n_lines"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_anomalies"))


@query(f"WITH {_SETS} SELECT index_name, md5(array_to_string(words, ' ')) AS words, round(distance, 6) AS distance FROM scored")
def set_cosine_distance(spark: SparkSession, sf: str) -> DataFrame:
    target, scored = _scored(spark, sf)
    said = target.select("index_name", F.md5(F.array_join("words", " ").cast("binary")).alias("said"), "t1", "t2").distinct()
    return said.join(scored, ["t1", "t2"]).select("index_name", F.col("said").alias("words"), F.round("distance", 6).alias("distance"))


@query(f"WITH {_SETS} SELECT cast(round(distance * 10) AS INTEGER) AS severity, count(*) AS n, round(avg(distance), 6) AS mean_distance FROM scored WHERE distance > 0.3 GROUP BY 1")
def severity_histogram(spark: SparkSession, sf: str) -> DataFrame:
    _, scored = _scored(spark, sf)
    return scored.where(F.col("distance") > P.THRESHOLD).groupBy(F.round(F.col("distance") * 10).cast("int").alias("severity")).agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance"))


@query(f"WITH {_SETS} SELECT source, count(*) AS n_anomalies, round(avg(distance), 6) AS mean_distance, row_number() OVER (ORDER BY round(avg(distance), 6) DESC, source) AS rank FROM sets JOIN scored USING (index_name, words) WHERE source NOT IN {BASELINE} AND distance > 0.3 GROUP BY source")
def log_report_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Reports by mean distance, farthest first; one row for each source, so the ranking window is small."""
    far = _per_source(spark, sf).where(F.col("distance") > P.THRESHOLD)
    per = far.groupBy("source").agg(F.sum("n").alias("n_anomalies"), F.round(F.sum(F.col("distance") * F.col("n")) / F.sum("n"), 6).alias("mean_distance"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_distance"), "source")).cast("long"))


@query(f"WITH {LINES} SELECT doc_id, pos, md5(line) AS line FROM lines")
def lines_split(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("line").cast("binary")).alias("line"))


@query(f"WITH {LINES} SELECT source, count(*) AS line_count, sum(strlen(line))::BIGINT AS byte_count FROM lines GROUP BY source")
def line_counters(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).groupBy("source").agg(F.count("*").alias("line_count"), F.sum(F.octet_length("line")).alias("byte_count"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: strlen(x) > 6000))::BIGINT AS n_dropped FROM documents")
def long_line_drop(spark: SparkSession, sf: str) -> DataFrame:
    long = F.filter(F.split("text", "\n", -1), lambda x: F.octet_length(x) > P.MAX_LINE_BYTES)
    return _table(spark, sf, "documents").select("doc_id", F.size(long).cast("long").alias("n_dropped"))


# Written by hand, not from the constants under test.
_TESTS = {
    "%DATE": "regexp_matches(w, '(?i)^(sunday|monday|tuesday|wednesday|thursday|friday|saturday|january|february|march|april|may|june|july|august|september|october|november|december|months?|weeds?|days?|hours?|minutes?)$')",
    "%HASH": "(w NOT LIKE '/%' AND regexp_matches(w, '(?i)^(hash|sha|md)[0-9]*[:~]|\\.?[a-zA-Z0-9_+/-]{64}'))",
    "%ID": "(regexp_matches(w, '^(:*[\\[\\]0-9a-fA-FxZ,]+[:.\\-]*|(latest|none)|rabbitmq-cluster-id-.*)+$') OR (regexp_matches(lower(w), '[bcdfghjklmnpqrstvwxz]') AND NOT regexp_matches(w, '[aeiouyAEIOUY]')))",
    "%COOKIE": "regexp_matches(w, '^(gAAAA|AAAA|tx[a-z]|tap|req-|AUTH_)')",
    "%UID": "regexp_matches(w, '^[a-zA-Z0-9].*-[a-zA-Z0-9]{4}-[a-zA-Z0-9]{4}-[a-zA-Z0-9]{4}-$')",
    "%URL": "regexp_matches(w, '(?i)^(https|http|ftp|ssh)://')",
    "%PATH": "(contains(w, 'tmp/') OR contains(w, '/tmp') OR starts_with(w, 'tmp'))",
    "%REF": "regexp_matches(w, '^(refs/|repos/)|^\\w{7}\\.\\.\\w{7}$')",
    "%BASE64": "(w LIKE '%==' OR (strlen(w) > 24 AND (w LIKE '%=' OR regexp_matches(w, '^[A-Za-z0-9+/=]+$'))))",
    "%UNIT": "regexp_matches(w, '^[a-z]+_[a-z]+\\[[0-9]+\\]:$')",
}


@query(f"WITH {WORDS} SELECT w AS word, CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in _TESTS.items()) + " END AS literal FROM words")
def word_literals(spark: SparkSession, sf: str) -> DataFrame:
    """The placeholder of every distinct word, the predicates tried in order."""
    return _words(spark, sf).select(F.col("w").alias("word"), words.literal(F.col("w")).alias("literal"))


def _predicate(kind: str, name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _words(spark, sf).where(words.LITERALS[kind](F.col("w"))).select(F.col("w").alias("word"))

    run.__name__ = name
    _REGISTERED[name] = (run, f"WITH {WORDS} SELECT w AS word FROM words WHERE {_TESTS[kind]}")


for _kind in words.LITERALS:
    _predicate(_kind, f"word_is_{_kind[1:].lower()}")


@query(f"WITH {WORDS} SELECT w AS word, regexp_replace(w, '[0-9]+\\.[0-9]+|[0-9]+', 'N', 'g') AS plain FROM words")
def remove_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf).select(F.col("w").alias("word"), words.remove_numbers(F.col("w")).alias("plain"))


@query(f"WITH {WORDS} SELECT w AS word FROM words WHERE regexp_matches(w, '(?i)^(error|fatal|failure|failed|warning|err|fail|warn|denied|assert|assertion|non-zero|exception|traceback)$') OR regexp_matches(w, '[<>{{}}%$,*]')")
def word_is_error_or_odd(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf).where(F.col("w").rlike(P.ERROR_WORD) | F.col("w").rlike(P.ODD)).select(F.col("w").alias("word"))


@query(None)
def tokenize_full(spark: SparkSession, sf: str) -> DataFrame:
    lines = _event_lines(spark, sf).select("event_id", "line")
    return tokenizer.with_tokens(lines).select("event_id", "tokens")


@query(f"""WITH {LINES}, keyed AS (SELECT *, array_to_string(list_sort(list_filter(string_split(line, ' '), lambda w: w NOT LIKE '\\%%' ESCAPE '\\')), ' ') AS key FROM lines)
 SELECT doc_id, pos, row_number() OVER (PARTITION BY index_name, key ORDER BY source, doc_id, pos) = 1 AS first FROM keyed""")
def unordered_key_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.first_of_key(_lines(spark, sf)).select("doc_id", F.col("pos").cast("long").alias("pos"), "first")


def _said(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.md5(x.cast("binary"))), ",")


@query(f"""WITH {_SETS}, n AS (SELECT doc_id, pos, line, distance > 0.3 AS anomaly, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM sets JOIN scored USING (index_name, words) WHERE source NOT IN {BASELINE}),
 m AS (SELECT *, min(CASE WHEN anomaly THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next,
   max(CASE WHEN anomaly THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
   list(md5(line)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS back, list(md5(line)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM n),
 g AS (SELECT *, seq - 1 - CASE WHEN prev IS NULL THEN 0 ELSE least(prev + 3, seq - 1) END AS gap FROM m WHERE anomaly),
 h AS (SELECT *, CASE WHEN gap < 12 THEN gap ELSE 3 END AS take, coalesce(len(back), 0) AS nb, least(3, coalesce(next - seq - 1, 3)) AS go FROM g)
 SELECT doc_id, pos, CASE WHEN take > 0 THEN coalesce(array_to_string(back[nb - take + 1:nb], ','), '') ELSE '' END AS before, CASE WHEN go > 0 THEN coalesce(array_to_string(ahead[1:go], ','), '') ELSE '' END AS after FROM h""")
def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of the target lines farther than the threshold from every baseline line."""
    target, scored = _scored(spark, sf)
    marked = target.join(scored, ["t1", "t2"]).withColumn("anomaly", F.col("distance") > P.THRESHOLD)
    return scoring.contexts(marked).select("doc_id", F.col("pos").cast("long").alias("pos"), _said("before").alias("before"), _said("after").alias("after"))


@query(f"WITH {EVENTS} SELECT event_id, {IS_ERROR} AS is_error FROM event_lines")
def error_line_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _event_lines(spark, sf).select("event_id", words.is_error_line(F.col("line")).alias("is_error"))


@query(f"WITH {EVENTS} SELECT event_id, epoch_ms(strptime(substr(line, 1, 23), '%Y-%m-%d %H:%M:%S,%g')) AS ts_ms FROM event_lines")
def timestamp_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _event_lines(spark, sf).select("event_id", times.full_timestamp(F.col("line")).alias("ts_ms"))


@query("""WITH t AS (SELECT event_id, epoch_us(ts) // 1000 AS ref, (epoch_us(ts) // 1000 + 25200000) % 86400000 AS tod FROM events), s AS (SELECT *, ref - ref % 86400000 + tod AS same FROM t)
 SELECT event_id, CASE WHEN same - ref > 43200000 THEN same - 86400000 WHEN ref - same > 43200000 THEN same + 86400000 ELSE same END AS ts_ms FROM s""")
def set_date(spark: SparkSession, sf: str) -> DataFrame:
    ref = F.unix_millis(F.col("ts").cast("timestamp"))
    return _table(spark, sf, "events").select("event_id", times.with_date(ref, F.pmod(ref + 7 * 3_600_000, F.lit(times.DAY_MS))).alias("ts_ms"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'error'")
def timeline_order(spark: SparkSession, sf: str) -> DataFrame:
    errors = _table(spark, sf, "events").where("event_type = 'error'")
    return errors.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("place"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages")
def href_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


@query("SELECT page_id, CASE WHEN url LIKE '%/index.html' THEN substr(url, 1, length(url) - 10) WHEN url LIKE '%/' THEN url END AS dir FROM pages")
def path_dir(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return _table(spark, sf, "pages").select("page_id", F.when(url.endswith("/index.html"), F.substring(url, F.lit(1), F.length(url) - 10)).when(url.endswith("/"), url).alias("dir"))


#: Endings for page addresses; the same text in both dialects.
_SUFFIX = "CASE page_id % 8 WHEN 0 THEN '.log' WHEN 1 THEN '/a.png.gz' WHEN 2 THEN '/happy' WHEN 3 THEN '/etc/x' WHEN 4 THEN '/.git/x' WHEN 5 THEN '/sos_commands/p/ps_x' WHEN 6 THEN '/job-output.json' ELSE '' END"
#: Written by hand, not from the constants under test.
_EXCLUDED = (
    ".ico$|.png$|.clf$|.tar.bzip2$|.subunit$|.sqlite$|.db$|.bin$|.rpm$|.pcap.log.txt$|.pkl$|.jar$|.pyc$|.py$|.sh$|.eot$|.otf$|.woff$|.woff2$|.ttf$|.yaml$|.ini$|.conf$|job-output.json$|zuul-manifest.json$|.html$"
    "|sos_commands/.*/(lsof|ps|journalctl|ls)_|sos_commands/scsi|cacerts$|local/creds$|/authkey$|mysql/tc.log.txt$|log/.tmp$|/etc/|/proc/|/sys/|/usr/lib/|/var/lib/selinux/|/venv/|/\\.[a-zA-Z0-9]"
)


@query(f"SELECT page_id, NOT regexp_matches(regexp_replace(url, '(\\.gz)+$', ''), '{_EXCLUDED}') AS included FROM (SELECT page_id, url || {_SUFFIX} AS url FROM pages)")
def path_exclude_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses with endings of all sorts."""
    url = F.concat("url", F.expr(_SUFFIX))
    return _table(spark, sf, "pages").select("page_id", paths.included(url).alias("included"))


@query(None)
def index_name_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", paths.index_name(F.regexp_replace("url", "^https?:/", "")).alias("index_name"))


@query(f"""WITH {LINES}, named AS (SELECT index_name || '/' || CAST(doc_id % 97 AS VARCHAR) AS index_name, source, doc_id, line FROM lines)
 SELECT index_name, source, count(*) AS n_lines FROM named t WHERE source NOT IN {BASELINE} AND NOT EXISTS (SELECT 1 FROM named b WHERE b.source IN {BASELINE} AND b.index_name = t.index_name) GROUP BY ALL""")
def unknown_index_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Indexes of all target lines, 97 a language, that no line of any baseline document has."""
    lines = _lines(spark, sf).withColumn("index_name", F.concat("index_name", F.lit("/"), (F.col("doc_id") % 97).cast("string")))
    known = lines.where(F.col("source").isin(*BASELINE)).select("index_name").distinct()
    return lines.where(~F.col("source").isin(*BASELINE)).join(known, "index_name", "left_anti").groupBy("index_name", "source").agg(F.count("*").alias("n_lines"))


@query(f"WITH {LINES}, s AS (SELECT md5(line) AS line, index_name, source FROM lines WHERE source IN {BASELINE}) SELECT index_name, line, count(DISTINCT source) AS n_models FROM s GROUP BY ALL")
def model_merge_distinct(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf).where(F.col("source").isin(*BASELINE))
    return lines.select("index_name", F.md5(F.col("line").cast("binary")).alias("line"), "source").distinct().groupBy("index_name", "line").agg(F.count("*").alias("n_models"))


_SHARED = f"{LINES}, s AS (SELECT DISTINCT md5(line) AS line, source FROM lines)"


@query(f"WITH {_SHARED} SELECT a.source AS t1, b.source AS t2, count(*) AS shared FROM s a JOIN s b ON a.line = b.line AND a.source < b.source GROUP BY ALL")
def similarity_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Lines shared by each pair of sources; a line's sources are few, so pairs are made from its sorted set."""
    held = _lines(spark, sf).select(F.md5(F.col("line").cast("binary")).alias("line"), "source").distinct()
    sets = held.groupBy("line").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.posexplode("s").alias("i", "t1"), "s").select("t1", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("t2"))
    return pairs.groupBy("t1", "t2").agg(F.count("*").alias("shared"))


@query(f"WITH {_SHARED} SELECT line, count(*) AS n_sources, min(source) AS first_source FROM s GROUP BY line ORDER BY n_sources DESC, line LIMIT 100")
def top_common(spark: SparkSession, sf: str) -> DataFrame:
    held = _lines(spark, sf).select(F.md5(F.col("line").cast("binary")).alias("line"), "source").distinct()
    return held.groupBy("line").agg(F.count("*").alias("n_sources"), F.min("source").alias("first_source")).orderBy(F.desc("n_sources"), "line").limit(100)


@query(f"WITH {_SETS}, per AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE distance > 0.3) AS a FROM sets JOIN scored USING (index_name, words) WHERE source NOT IN {BASELINE} GROUP BY source) SELECT source, round(100 - a * 100.0 / n, 4) AS reduction FROM per")
def reduction_percent(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly_source_counts(spark, sf).select("source", F.round(100 - F.col("n_anomalies") * 100.0 / F.col("n_lines"), 4).cast("double").alias("reduction"))


@query("SELECT source, upper(sha256(source)) AS path, sum(n_chars)::BIGINT AS bytes_size FROM documents GROUP BY source")
def sha_model_path(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").groupBy("source").agg(F.upper(F.sha2(F.col("source").cast("binary"), 256)).alias("path"), F.sum("n_chars").alias("bytes_size"))


@query("""WITH m AS (SELECT source, sum(n_chars)::BIGINT AS bytes_size, min(doc_id) AS created FROM documents GROUP BY source), r AS (SELECT *, sum(bytes_size) OVER (ORDER BY created, source ROWS UNBOUNDED PRECEDING) - bytes_size AS freed FROM m)
 SELECT source, bytes_size FROM r WHERE freed < (SELECT sum(bytes_size) FROM m) / 2""")
def reclaim_oldest(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest models whose removal frees half of the space; one row for each model."""
    m = _table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("bytes_size"), F.min("doc_id").alias("created"))
    order = Window.orderBy("created", "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("bytes_size").over(Window.partitionBy())
    return m.withColumn("freed", F.sum("bytes_size").over(order) - F.col("bytes_size")).withColumn("total", total).where("freed < total / 2").select("source", "bytes_size")


@query("""SELECT event_id, score FROM (SELECT event_id, user_id, 50 * (user_id % 3 = 0)::BIGINT + 50 * (event_type = 'purchase')::BIGINT + 10 * (value > 50)::BIGINT - greatest(date_diff('day', ts, TIMESTAMP '2024-06-01'), 0) AS score,
   row_number() OVER (PARTITION BY user_id ORDER BY 50 * (user_id % 3 = 0)::BIGINT + 50 * (event_type = 'purchase')::BIGINT + 10 * (value > 50)::BIGINT - greatest(date_diff('day', ts, TIMESTAMP '2024-06-01'), 0) DESC, event_id) AS r FROM events) WHERE r = 1""")
def baseline_score_top1(spark: SparkSession, sf: str) -> DataFrame:
    """The best scored candidate of each user, by a map-side maximum."""
    age = F.greatest(F.datediff(F.lit("2024-06-01").cast("date"), F.col("ts").cast("date")), F.lit(0))
    score = 50 * (F.col("user_id") % 3 == 0).cast("long") + 50 * (F.col("event_type") == "purchase").cast("long") + 10 * (F.col("value") > 50).cast("long") - age
    best = _table(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct(score.alias("score"), (-F.col("event_id")).alias("e"))).alias("m"))
    return best.select((-F.col("m.e")).alias("event_id"), F.col("m.score").alias("score"))


@query("SELECT vec_id, round(list_dot_product(embedding, embedding), 3) AS norm2 FROM embeddings")
def embedding_norm(spark: SparkSession, sf: str) -> DataFrame:
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return _table(spark, sf, "embeddings").select("vec_id", F.round(squares, 3).alias("norm2"))


@query("""WITH p AS (SELECT event_id, list_filter(string_split_regex(props, '[,{}\\[\\]]'), lambda x: x <> '') AS l FROM events)
 SELECT event_id, unnest(range(1, len(l) + 1)) AS seq, 1::BIGINT AS pos, unnest(l) AS line FROM p""")
def split_json(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of the properties; they hold no punctuation inside strings, so SQL can tell."""
    return splitting.split(_table(spark, sf, "events"), "event_id", "props", "json")


@query(None)
def split_xml(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split(_table(spark, sf, "pages"), "page_id", "html", "xml")


@query(None)
def split_text(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split(_table(spark, sf, "documents"), "doc_id", "text")


@query(None)
def error_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of each user's events, with the lines around them."""
    lines = _event_lines(spark, sf).select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("seq"), F.col("event_id").alias("pos"), "line")
    return errors.error_contexts(lines)


@query(f"WITH {EVENTS} SELECT user_id::VARCHAR AS source, event_id AS pos, md5(line) AS line FROM event_lines WHERE {IS_ERROR}")
def error_lines_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """What error_contexts finds, without the contexts: events hold no traces."""
    return error_contexts(spark, sf).select("source", "pos", F.md5(F.col("line").cast("binary")).alias("line"))

"""Queries over addresses, CI records, configuration, times, catalogs and paths, with their SQL.

Where the driver's tables hold nothing of the kind, rows are made from events or pages by expressions that both sides
share; what is under test is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions import ci, config, paths, times, urls
from ..sources import generate
from .registry import LINES, _lines, _table, query

_HEX = "substr(concat('0123456789abcdef0123456789abcdef', e), length(e) + 1, 32)"
#: Addresses of all kinds from an event's number e.
_URL = f"""CASE event_id % 9 WHEN 0 THEN concat('https://ci.example/t/tenant', e, '/build/', {_HEX}) WHEN 1 THEN concat('https://ci.example/build/', {_HEX}) WHEN 2 THEN concat('https://ci.example/build/short', e)
 WHEN 3 THEN concat('https://prow.ci.openshift.org/view/gs/bucket/pr-logs/pull/org_repo/', e, '/pull-job/16', e) WHEN 4 THEN concat('https://prow.example/view/gs/bucket/pr-logs/pull/org_repo/', e, '/pull-job/16', e)
 WHEN 5 THEN concat('https://logs.example/', e, '/') WHEN 6 THEN concat('https://logs.example/', e, '/index.html?x=1') WHEN 7 THEN concat('https://logs.example/', e, '/a.log') ELSE concat('/var/log/', e, '.log') END"""
_ADDRESSES = f"a AS (SELECT event_id, {_URL} AS url FROM (SELECT event_id, CAST(event_id AS VARCHAR) AS e FROM events)), s AS (SELECT *, regexp_replace(url, '[?#].*$', '') AS bare FROM a)"


def _addresses(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").withColumn("e", F.col("event_id").cast("string")).select("event_id", F.expr(_URL).alias("url"))


@query(f"""WITH {_ADDRESSES} SELECT event_id, CASE WHEN url NOT LIKE 'http%' THEN 'path' WHEN regexp_matches(bare, '/build/[0-9a-zA-Z]{{32}}$') THEN 'ci'
 WHEN regexp_matches(bare, '^https://prow.ci.openshift.org/view/[^/]+/[^/]+/pr-logs/pull/[^/]+/[0-9]+/[^/]+/[0-9]*$') THEN 'prow' WHEN bare LIKE '%/' THEN 'directory' ELSE 'file' END AS kind FROM s""")
def content_kind(spark: SparkSession, sf: str) -> DataFrame:
    return _addresses(spark, sf).select("event_id", urls.content_kind(F.col("url")).alias("kind"))


@query(f"""WITH {_ADDRESSES} SELECT event_id, CASE WHEN bare LIKE '%/t/%' THEN 'https://ci.example/api/tenant/tenant' || event_id || '/' ELSE 'https://ci.example/api/' END AS api, right(bare, 32) AS uuid,
 CASE WHEN bare LIKE '%/t/%' THEN 'https://ci.example/t/tenant' || event_id || '/build/' ELSE 'https://ci.example/build/' END || right(bare, 32) AS page FROM s WHERE regexp_matches(bare, '/build/[0-9a-zA-Z]{{32}}$')""")
def ci_api_url(spark: SparkSession, sf: str) -> DataFrame:
    """The API address and id of a build page, and the page made of them again."""
    b = _addresses(spark, sf).withColumn("b", urls.ci_build(F.col("url"))).where("b is not null").select("event_id", "b.*")
    return b.withColumn("page", urls.build_page(F.col("api"), F.col("uuid")))


@query(f"""WITH {_ADDRESSES}, p AS (SELECT event_id, string_split(bare, '/') AS p FROM s WHERE bare LIKE '%/view/%')
 SELECT event_id, p[5] AS storage_type, p[6] AS storage_path, p[9] AS project, p[10]::BIGINT AS pr, p[11] AS job_name, p[12] AS uid FROM p""")
def prow_url_parse(spark: SparkSession, sf: str) -> DataFrame:
    b = _addresses(spark, sf).withColumn("b", urls.prow_build(F.col("url"))).where("b is not null")
    return b.select("event_id", "b.storage_type", "b.storage_path", "b.project", "b.pr", "b.job_name", "b.uid")


@query(f"WITH {_ADDRESSES} SELECT event_id, CASE WHEN bare LIKE '%/index.html' THEN left(bare, length(bare) - 10) WHEN bare LIKE '%/' THEN url END AS dir FROM s")
def address_directory(spark: SparkSession, sf: str) -> DataFrame:
    return _addresses(spark, sf).select("event_id", urls.path_dir(F.col("url")).alias("dir"))


#: An index page from an event: up, relative, dotted, absolute and full links, and a footer.
_PAGE = "concat('<a href=\"../\">up</a><a href=\"./a', e, '.log\">x</a><a href=\"sub', e, '/\">y</a><a href=\"/top/', e, '\">z</a><a href=\"https://o.example/', e, '\">o</a><a href=\"?C=N\">s</a><h3>Logs of interest</h3><a href=\"late\">l</a>')"


@query("""SELECT event_id, unnest(['https://logs.example/d' || event_id || '/a' || event_id || '.log', 'https://logs.example/d' || event_id || '/sub' || event_id || '/', 'https://logs.example/top/' || event_id, 'https://o.example/' || event_id]) AS link FROM events""")
def index_page_links(spark: SparkSession, sf: str) -> DataFrame:
    """The links of index pages, resolved, up to the footer."""
    pages = _table(spark, sf, "events").withColumn("e", F.col("event_id").cast("string")).select("event_id", F.concat(F.lit("https://logs.example/d"), "e", F.lit("/index.html")).alias("base"), F.expr(_PAGE).alias("page"))
    return pages.select("event_id", F.explode(urls.index_links(F.col("base"), F.col("page"))).alias("link"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]+') AS origin, regexp_extract(regexp_replace(url, '^[a-z]+://[^/]+', ''), '^.*/') AS dir, unnest(regexp_extract_all(split_part(html, 'Logs of interest', 1), '<a href="(?:\\./)*([\\\\/a-zA-Z0-9][^"]+)"', 1)) AS href FROM pages)
 SELECT page_id, CASE WHEN regexp_matches(href, '^[a-zA-Z]+://') THEN href WHEN href LIKE '/%' THEN origin || href ELSE origin || CASE WHEN dir = '' THEN '/' ELSE dir END || href END AS link FROM p""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the pages table."""
    return _table(spark, sf, "pages").select("page_id", F.explode(urls.index_links(F.col("url"), F.col("html"))).alias("link"))


@query("SELECT event_id, 'https://store.example/' || event_id AS link FROM events WHERE event_id % 2 = 0")
def prow_artifacts_link(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    page = F.concat(F.lit('<p><a href="https://x/y">Other</a> <a href="https://store.example/'), e, F.lit('">'), F.when(F.col("event_id") % 2 == 0, "Artifacts").otherwise("Logs"), F.lit("</a>"))
    return _table(spark, sf, "events").select("event_id", urls.artifacts_link(page).alias("link")).where("link is not null")


@query("SELECT event_id, ['File', 'Directory', 'Ci', 'Prow'][event_id % 4 + 1] || '(/x/' || event_id || ')' AS id, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE (event_id + 1) || ' ' || (user_id + 1) || ' 4' END AS ids FROM events")
def content_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Names of contents, and lists of report ids (null where one is no number)."""
    kind = F.get(F.array(*(F.lit(k) for k in ("file", "directory", "ci", "prow"))), (F.col("event_id") % 4).cast("int"))
    listed = F.concat_ws(":", "event_id", "user_id", F.when(F.col("event_id") % 5 == 0, "x").otherwise("3"))
    return _table(spark, sf, "events").select("event_id", urls.content_id(kind, F.concat(F.lit("/x/"), "event_id")).alias("id"), F.coalesce(F.array_join(F.transform(urls.id_list(listed), lambda x: (x + 1).cast("string")), " "), F.lit("none")).alias("ids"))


_NAME = "CASE event_id % 7 WHEN 0 THEN 'logs/job-output.txt' WHEN 1 THEN 'job-output.txt' WHEN 2 THEN 'a/my-ansible.log' WHEN 3 THEN 'ansible/x.log' WHEN 4 THEN 'a/b.tar.gz' WHEN 5 THEN 'a/b.tar' ELSE 'a/b.tgz' END"


@query(f"""SELECT event_id, name, position('/' IN name) > 0 AND (regexp_matches(name, '/job-output[^/]*$') OR regexp_matches(name, '/[^/]*ansible[^/]*$')) AS is_output, name LIKE '%.tar' OR name LIKE '%.tar.gz' OR name LIKE '%.tar.xz' AS is_archive
 FROM (SELECT event_id, {_NAME} AS name FROM events)""")
def source_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Job outputs and archives by their names."""
    named = _table(spark, sf, "events").select("event_id", F.expr(_NAME).alias("name"))
    return named.select("event_id", "name", urls.is_job_output(F.col("name")).alias("is_output"), urls.is_archive(F.col("name")).alias("is_archive"))


@query("SELECT event_id, event_id % 3 = 0 OR epoch(ts)::BIGINT < epoch(TIMESTAMP '2024-06-01') AS older FROM events")
def source_older_than(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a source is older than a day; remote ones (here every third) always count as older."""
    than = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return _table(spark, sf, "events").select("event_id", urls.older_than(F.col("event_id") % 3 != 0, F.col("ts").cast("timestamp"), than).alias("older"))


_PATHS = "CASE page_id % 5 WHEN 0 THEN concat('/sos/sosreport-host', p, '/var/log/messages-2024.txt.gz') WHEN 1 THEN concat('/undercloud/var/log/containers/nova-api.log.', p, '.gz') WHEN 2 THEN concat('/a/logs/', p, '/instance-0000', p, '.log') WHEN 3 THEN concat('/system.journal/user-', p, '@abc.journal~') ELSE concat('/controller/logs/util/', p, '/k8s_', p, '_foo.bar.txt') END"
_DULL = "regexp_matches(x, '^[0-9a-fA-F]*$') OR NOT regexp_matches(x, '[aeiouyAEIOUY]')"


def _clean_sql(n: str) -> str:
    kept = f"regexp_replace(array_to_string(list_filter(regexp_extract_all({n}, '[^\\-_.]*[\\-_.]|[^\\-_.]+'), lambda x: NOT ({_DULL})), ''), '[^A-Za-z.\\-]', '', 'g')"
    trimmed = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({kept}, '(\\.gz)+$', ''), '(\\.txt)+$', ''), '^[._\\-]+', ''), '[._\\-]+$', '')"
    return f"CASE WHEN {n} LIKE 'instance-00%' THEN 'instance' WHEN position('@' IN {n}) > 0 THEN split_part({n}, '@', 1) WHEN {n} LIKE 'sosreport-%' THEN regexp_extract({n}, '^sosreport-[^-]*') ELSE {trimmed} END"


@query(f"""WITH p AS (SELECT page_id, {_PATHS} AS path FROM (SELECT page_id, CAST(page_id AS VARCHAR) AS p FROM pages)),
 l AS (SELECT page_id, list_filter(string_split(regexp_replace(path, '[0-9a-zA-Z]{{63,128}}|[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', 'UID', 'g'), '/'), lambda x: x <> '') AS l FROM p),
 d AS (SELECT page_id, regexp_replace(l[len(l)], '\\.journal~?$', '') AS f, list_filter(l[1:len(l) - 1], lambda x: NOT ({_DULL} OR x IN ('util', 'tasks', 'manager', 'current', 'logs', 'init'))) AS dirs FROM l),
 n AS (SELECT page_id, f, regexp_replace(dirs[len(dirs)], '\\.journal~?$', '') AS dir FROM d)
 SELECT page_id, CASE WHEN dir IS NULL THEN '' ELSE ({_clean_sql('dir')}) || '/' END || ({_clean_sql('f')}) AS index_name FROM n""")
def index_name_of_path(spark: SparkSession, sf: str) -> DataFrame:
    """The index a path belongs to: nearest telling folder and file name, without what changes."""
    path = _table(spark, sf, "pages").withColumn("p", F.col("page_id").cast("string")).select("page_id", F.expr(_PATHS).alias("path"))
    return path.select("page_id", paths.index_name(F.col("path")).alias("index_name"))


@query("SELECT page_id, 'a/b__' || split_part(url, '/', 3) AS index_name FROM pages")
def index_name_extend(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", urls.extended(F.lit("a/b"), F.split("url", "/", -1)[2]).alias("index_name"))


# CI records, legacy and new by turns, every seventh broken
_FIELDS = {"uuid": "u{e}", "job_name": "job-{m}", "result": "SUCCESS"}


def _builds(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    common = [
        F.when(e % 7 != 0, F.concat(F.lit("u"), e)).alias("uuid"), F.concat(F.lit("job-"), e % 5).alias("job_name"), F.when(e % 3 == 0, "SUCCESS").otherwise("FAILURE").alias("result"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("start_time"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(e % 2 == 0, "Z").otherwise("")).alias("end_time"), (F.col("value") / 3).alias("duration"),
        (e % 2 == 0).alias("voting"), F.when(e % 11 != 0, F.concat(F.lit("https://l/"), e)).alias("log_url"), F.array().cast("array<struct<name:string,url:string>>").alias("artifacts"),
        F.when(e % 4 == 0, "gate").otherwise("check").alias("pipeline"), F.lit("ev").alias("event_id"),
    ]
    change = [F.concat(F.lit("p"), e % 6).alias("project"), F.when(e % 8 == 0, "dev").otherwise("main").alias("branch"), (e % 50).alias("change"), F.lit("1").alias("patchset"), F.concat(F.lit("https://r/"), e % 50).alias("ref_url"), F.concat(F.lit("refs/"), e).alias("ref")]
    text = F.when(e % 2 == 0, F.to_json(F.struct(*common, *change))).otherwise(F.to_json(F.struct(*common, F.struct(*change).alias("ref"))))
    return _table(spark, sf, "events").select("event_id", text.alias("text"))


_BUILDS_SQL = """b AS (SELECT 'u' || event_id AS uuid, 'job-' || (event_id % 5) AS job_name, CASE WHEN event_id % 3 = 0 THEN 'SUCCESS' ELSE 'FAILURE' END AS result, date_trunc('second', ts) AS end_time, event_id % 2 = 0 AS voting,
  CASE WHEN event_id % 11 <> 0 THEN 'https://l/' || event_id END AS log_url, 'https://r/' || (event_id % 50) AS ref_url, CASE WHEN event_id % 4 = 0 THEN 'gate' ELSE 'check' END AS pipeline, 'p' || (event_id % 6) AS project,
  CASE WHEN event_id % 8 = 0 THEN 'dev' ELSE 'main' END AS branch, event_id % 50 AS change, 'refs/' || event_id AS ref, trunc(value / 3)::BIGINT AS duration FROM events WHERE event_id % 7 <> 0)"""


@query(f"WITH {_BUILDS_SQL} SELECT uuid, job_name, result, epoch(end_time)::BIGINT AS end_time, duration, voting, log_url, ref_url, pipeline, project, branch, change, ref FROM b")
def ci_builds_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Build records of both formats, those without an id left out."""
    arrays = _builds(spark, sf).groupBy((F.col("event_id") % 16).alias("page")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("text"), ","), F.lit("]")).alias("text"))
    b = ci.decode_builds(arrays, "text")
    return b.select("uuid", "job_name", "result", F.col("end_time").cast("long").alias("end_time"), "duration", "voting", "log_url", "ref_url", "pipeline", "project", "branch", "change", "ref")


_BUILD = {"project": "p1", "change": 7, "ref_url": "https://r/7", "branch": "main", "uuid": "u1"}
_SCORE_SQL = """CASE WHEN project <> 'p1' THEN 0 WHEN change = 7 OR ref_url = 'https://r/7' THEN -500 ELSE 50 END + CASE WHEN branch = 'main' THEN 50 ELSE 0 END + CASE WHEN pipeline LIKE '%gate%' OR pipeline LIKE '%periodic%' THEN 50 ELSE 0 END
  + CASE WHEN voting THEN 10 ELSE 0 END - greatest(date_diff('day', end_time::DATE, DATE '2024-07-01'), 0)"""


@query(f"WITH {_BUILDS_SQL} SELECT uuid, CASE WHEN log_url IS NOT NULL AND ref_url IS NOT NULL THEN ({_SCORE_SQL})::BIGINT ELSE -9999 END AS score FROM b")
def baseline_scores(spark: SparkSession, sf: str) -> DataFrame:
    b = _builds(spark, sf).select(ci.decode_build(F.col("text")).alias("b")).where("b is not null").select("b.*")
    return b.select("uuid", ci.baseline_score(_BUILD, F.lit("2024-07-01").cast("date")).cast("long").alias("score")).fillna(-9999, "score")


@query(f"WITH {_BUILDS_SQL} SELECT uuid, ({_SCORE_SQL})::BIGINT AS score FROM b WHERE log_url IS NOT NULL AND uuid <> 'u1' ORDER BY score DESC, uuid LIMIT 1")
def baseline_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """The best baseline of a build."""
    b = _builds(spark, sf).select(ci.decode_build(F.col("text")).alias("b")).where("b is not null").select("b.*")
    return ci.discover(b, _BUILD, F.lit("2024-07-01").cast("date")).select("uuid", F.col("score").cast("long").alias("score"))


@query("SELECT event_id, unnest(['https://l/' || event_id || '/a%20b.log', 'https://l/' || event_id || '/d%2B/x.log']) AS file FROM events")
def manifest_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files of a manifest tree, names percent-encoded."""
    tree = '{"tree": [{"name": "a b.log", "mimetype": "text/plain"}, {"name": "d+", "mimetype": "application/directory", "children": [{"name": "x.log", "mimetype": "text/plain"}, {"name": "empty", "mimetype": "application/directory"}]}]}'
    return _table(spark, sf, "events").select("event_id", F.explode(ci.manifest_urls(F.lit(tree), F.concat(F.lit("https://l/"), "event_id"))).alias("file"))


@query("SELECT user_id, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events) WHERE place <= 200 AND event_type = 'purchase' GROUP BY user_id")
def first_success(spark: SparkSession, sf: str) -> DataFrame:
    """The first success (a purchase here) among the first 200 of each job (a user)."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    some = _table(spark, sf, "events").withColumn("place", place).where("place <= 200 and event_type = 'purchase'")
    return some.groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT user_id, event_id::VARCHAR AS id FROM events")
def job_history_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The builds that a job's history page carries in its script."""
    builds = _table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.to_json(F.struct(F.col("event_id").cast("string").alias("ID"), F.lit("SUCCESS").alias("Result"))).alias("j")))).alias("b"))
    page = F.concat(F.lit("<script>\n  var allBuilds = ["), F.array_join(F.transform("b", lambda x: x["j"]), ","), F.lit("];\n</script>"))
    return builds.select("user_id", F.explode(ci.job_history(page)).alias("b")).select("user_id", F.col("b.ID").alias("id"))


# configuration
_CONFIG = config.parse('[{"match_job": "^job-1", "config": {}}, {"match_job": "2$", "config": {"ignore_patterns": ["a"]}}, {"match_job": "job-[0-3]", "config": {"includes": ["service"], "default_excludes": false, "excludes": ["x.log"]}}]', "c.json")


@query("SELECT event_id, CASE WHEN j LIKE 'job-1%' THEN 0 WHEN j LIKE '%2' THEN 1 WHEN regexp_matches(j, 'job-[0-3]') THEN 2 ELSE -1 END AS matcher FROM (SELECT event_id, 'job-' || (event_id % 17) AS j FROM events)")
def config_first_match(spark: SparkSession, sf: str) -> DataFrame:
    """The first matcher of each job."""
    return _table(spark, sf, "events").select("event_id", _CONFIG.match(F.concat(F.lit("job-"), F.col("event_id") % 17)).alias("matcher")).fillna(-1, "matcher")


@query("SELECT page_id, contains(regexp_replace(url, '(\\.gz)+$', ''), 'a') AND NOT regexp_matches(regexp_replace(url, '(\\.gz)+$', ''), 'e/1') AS included FROM pages")
def config_include_exclude(spark: SparkSession, sf: str) -> DataFrame:
    target = config.TargetConfig(includes=["a"], excludes=["e/1"], default_excludes=False)
    return _table(spark, sf, "pages").select("page_id", target.included(F.col("url")).alias("included"))


@query(f"WITH {LINES} SELECT doc_id, pos::BIGINT AS pos FROM lines WHERE NOT regexp_matches(line, 'ab|^The')")
def ignored_lines(spark: SparkSession, sf: str) -> DataFrame:
    target = config.TargetConfig(ignore_patterns=["ab", "^The"])
    return _lines(spark, sf).where(~target.ignored(F.col("line"))).select("doc_id", F.col("pos").cast("long").alias("pos"))


# times
_STAMPS = (
    "yyyy-MM-dd HH:mm:ss,SSS' INFO'", "yyyy-MM-dd'T'HH:mm:ss'Z x'", "yyyy-MM-dd HH:mm:ss.SSS'123'", "yyyy-MM-dd HH:mm:ss' E0814'", "'['yyyy/MM/dd HH:mm:ss']'", "' 'yyyy-MM-dd HH:mm:ss", "'I0220 'HH:mm:ss.SSS'309 x'", "'Feb 27 'HH:mm:ss' x'", "'none at all'",
)


@query("""WITH t AS (SELECT event_id, event_id % 9 AS k, epoch_us(ts) // 1000 AS full_ms, epoch_us(ts) // 1000000 * 1000 AS sec_ms FROM events)
 SELECT event_id, CASE WHEN k IN (0, 2) THEN full_ms WHEN k IN (1, 3, 4) THEN sec_ms ELSE -1 END AS full_ms, CASE WHEN k = 6 THEN full_ms % 86400000 WHEN k = 7 THEN sec_ms % 86400000 ELSE -1 END AS time_ms FROM t""")
def timestamp_formats(spark: SparkSession, sf: str) -> DataFrame:
    """All forms of time at the head of a line; an indented line has none."""
    k = F.col("event_id") % len(_STAMPS)
    line = F.coalesce(*(F.when(k == i, F.date_format("ts", f)) for i, f in enumerate(_STAMPS)))
    lines = _table(spark, sf, "events").select("event_id", line.alias("line"))
    return lines.select("event_id", times.full_timestamp(F.col("line")).alias("full_ms"), times.time_of_day(F.col("line")).alias("time_ms")).fillna(-1, ["full_ms", "time_ms"])


@query("""WITH p AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || ' - svc: ' AS head, string_split(event_type || chr(10) || props, chr(10)) AS parts FROM events)
 SELECT event_id, unnest(range(1, len(parts) + 1)) AS part, unnest([head || parts[1], repeat(' ', length(head)) || parts[2]]) AS line FROM p""")
def journal_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Journal entries as lines; further lines of a message are indented."""
    head = F.concat(times.journal_stamp(F.unix_micros(F.col("ts").cast("timestamp"))), F.lit(" - svc: "))
    parts = F.split(F.concat("event_type", F.lit("\n"), "props"), "\n", -1)
    made = F.transform(parts, lambda x, i: F.concat(F.when(i == 0, head).otherwise(F.repeat(F.lit(" "), F.octet_length(head))), x))
    return _table(spark, sf, "events").select("event_id", F.posexplode(made).alias("part", "line")).withColumn("part", (F.col("part") + 1).cast("long"))


@query("""SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN format('{:.2f}', ms / 1000.0) || 's' WHEN ms < 3600000 THEN (ms // 60000) || 'm' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || 's'
 ELSE (ms // 3600000) || 'h' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || 'm' END AS said FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 1000 WHEN 1 THEN event_id % 600 * 100 WHEN 2 THEN event_id * 977 % 3600000 ELSE event_id * 98765 END AS ms FROM events)""")
def human_durations(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    ms = F.when(e % 4 == 0, e % 1000).when(e % 4 == 1, e % 600 * 100).when(e % 4 == 2, e * 977 % 3600000).otherwise(e * 98765)
    return _table(spark, sf, "events").select("event_id", times.human_duration(ms).alias("said"))


@query("SELECT event_id, epoch(TIMESTAMP '2024-07-01')::BIGINT - epoch(date_trunc('second', ts))::BIGINT > 20 * 86400 AS too_old, greatest(date_diff('day', ts::DATE, DATE '2024-07-01'), 0)::INTEGER AS days FROM events")
def model_age(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return _table(spark, sf, "events").select("event_id", times.too_old(ts, F.lit("2024-07-01 00:00:00").cast("timestamp"), 20).alias("too_old"), ci.elapsed_days(ts, F.lit("2024-07-01").cast("date")).alias("days"))


# catalogs: events as appended rows, a user as a report
def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("id"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.concat(F.lit("t"), F.col("user_id") % 10).alias("target"), F.concat(F.lit("b"), F.col("user_id") % 3).alias("baseline"),
        F.col("event_id").alias("anomaly_count"), F.when(F.col("event_type") == "click", "pending").otherwise("completed").alias("status"), (F.col("event_id") % 1000).alias("bytes_size"), (F.col("user_id") % 2 == 0).alias("errors"), F.col("event_id").alias("version"),
    )


_LATEST = "r AS (SELECT user_id AS id, 't' || (user_id % 10) AS target, 'b' || (user_id % 3) AS baseline, event_id AS anomaly_count, CASE WHEN event_type = 'click' THEN 'pending' ELSE 'completed' END AS status, event_id % 1000 AS bytes_size, user_id % 2 = 0 AS errors, ts AS created_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"


@query(f"WITH {_LATEST} SELECT id, anomaly_count, status FROM r ORDER BY id DESC")
def catalog_newest(spark: SparkSession, sf: str) -> DataFrame:
    """The last row of each report, newest id first."""
    return catalog.newest(_catalog(spark, sf)).select("id", "anomaly_count", "status")


@query(f"WITH {_LATEST} SELECT id, status FROM r WHERE target = 't4' AND baseline = 'b1' AND errors")
def catalog_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.lookup_report(_catalog(spark, sf), "t4", "b1", True)


@query(f"WITH {_LATEST} SELECT id, status FROM r WHERE status <> 'pending'")
def catalog_clean_pending(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.without_pending(_catalog(spark, sf)).select("id", "status")


@query(f"WITH {_LATEST} SELECT 't' || id AS content_id, bytes_size FROM r WHERE id % 4 = 1")
def catalog_current_models(spark: SparkSession, sf: str) -> DataFrame:
    """Models of the present format; the version of a model is its report's id modulo 4 here."""
    models = _catalog(spark, sf).select(F.concat(F.lit("t"), "id").alias("content_id"), (F.col("id") % 4).alias("model_version"), "created_at", "bytes_size", "errors", "version")
    return catalog.current_models(models).select("content_id", "bytes_size")


@query(f"WITH {_LATEST} SELECT sum(bytes_size)::BIGINT AS bytes_size FROM r")
def bytes_sum(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.bytes_used(catalog.latest(_catalog(spark, sf), "id"))


@query(f"WITH {_LATEST}, n AS (SELECT *, (row_number() OVER (ORDER BY created_at, id) - 1) // 20 AS batch FROM r), f AS (SELECT batch, sum(sum(bytes_size)) OVER (ORDER BY batch) - sum(bytes_size) AS before FROM n GROUP BY batch) SELECT id, bytes_size FROM n WHERE batch IN (SELECT batch FROM f WHERE before < 40000)")
def reclaim_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest reports, in batches of twenty, until 40,000 bytes are free."""
    return catalog.reclaimed(catalog.latest(_catalog(spark, sf), "id"), 40_000).select("id", "bytes_size")


@query(f"WITH {_LATEST} SELECT id, created_at > TIMESTAMP '2024-06-10' AS reuse FROM r")
def model_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """A model is used again if its content is older than it is."""
    rows = catalog.latest(_catalog(spark, sf), "id")
    return rows.select("id", (F.col("created_at") > F.lit("2024-06-10 00:00:00").cast("timestamp_ntz")).alias("reuse"))


# vectors
@query("SELECT a.vec_id, round(list_dot_product(a.embedding, b.embedding)::DOUBLE / (sqrt(list_dot_product(a.embedding, a.embedding)::DOUBLE) * sqrt(list_dot_product(b.embedding, b.embedding)::DOUBLE)), 3) + 0.0 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 10")
def embedding_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """The cosine of each vector with the first of its ten."""
    e = _table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = e.join(e.select(F.col("vec_id").alias("other"), F.col("v").alias("w")), F.col("other") == F.col("vec_id") - F.col("vec_id") % 10)
    return pairs.select("vec_id", (F.round(dot("v", "w") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("w", "w"))), 3) + 0.0).alias("cosine"))


@query(None)
def generated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return generate.lines(spark, 20_000)

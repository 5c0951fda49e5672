"""Queries over training, scoring, reports, errors and similarity, with their SQL.

The SQL cannot tokenise, so where it stands the lines themselves serve as tokens; the same operators run on tokens in
the queries whose names end in ``_tokens``, which tests hold against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import TargetConfig
from ..operators import known, reports, similarity
from .registry import BASELINE, EVENTS, IS_ERROR, LINES, _event_lines, _lines, _said, _table, query

IGNORED = "qua|zz"
SETTING = TargetConfig(ignore_patterns=[IGNORED])


def _sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(target, baseline) lines; each document is a source of its own."""
    lines = _lines(spark, sf)
    base = F.col("source").isin(*BASELINE)
    named = lines.withColumn("base", base).withColumn("source", F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".log")))
    named = named.select("index_name", "source", F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), "line", "base")
    return named.where(~F.col("base")).drop("base"), named.where("base").drop("base")


def _on(target: DataFrame, baseline: DataFrame, words: bool, config: TargetConfig | None = None) -> tuple[DataFrame, reports.Model]:
    tokens = F.col("line") if words else None
    model = reports.train(baseline, config, tokens)
    return reports.score(target, model, config, tokens), model


#: Lines, their keys, first lines of keys, distances, anomalies and kept anomalies; {where} leaves lines out, {index} names the model's index.
_SCORED = """{lines}, named AS (SELECT index_name, source || '/doc-' || doc_id || '.log' AS source, source IN {baseline} AS base, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq, pos, line FROM lines WHERE {where}),
 keyed AS (SELECT *, array_to_string(list_sort(list_filter(string_split(line, ' '), lambda w: w NOT LIKE '\\%%' ESCAPE '\\')), ' ') AS key,
   list_sort(list_distinct(list_filter(string_split(line, ' '), lambda w: w <> ''))) AS words FROM named),
 b AS (SELECT row_number() OVER () AS b, * FROM (SELECT DISTINCT index_name, words FROM (SELECT * FROM keyed WHERE base QUALIFY row_number() OVER (PARTITION BY index_name, key ORDER BY source, seq) = 1) WHERE len(words) > 0 AND {of_model})),
 t1 AS (SELECT *, {index} AS model_index, row_number() OVER (PARTITION BY index_name, key ORDER BY source, seq) = 1 AS first FROM keyed WHERE NOT base),
 t AS (SELECT row_number() OVER () AS t, * FROM (SELECT DISTINCT model_index, words FROM t1 WHERE first)),
 common AS (SELECT t, b, count(*) AS c FROM (SELECT t, model_index AS index_name, unnest(words) AS w FROM t) JOIN (SELECT b, index_name, unnest(words) AS w FROM b) USING (index_name, w) GROUP BY t, b),
 best AS (SELECT t, max(c / sqrt(len(t.words)::DOUBLE * len(b.words))) AS s FROM common JOIN t USING (t) JOIN b USING (b) GROUP BY t),
 dist AS (SELECT t.model_index, t.words, greatest(0.0, 1 - coalesce(s, 0)) AS distance FROM t LEFT JOIN best USING (t)),
 scored AS (SELECT t1.* EXCLUDE (model_index, words), CASE WHEN first THEN distance END AS distance, coalesce(first AND distance > 0.3, false) AS anomaly FROM t1 JOIN dist ON t1.model_index = dist.model_index AND t1.words = dist.words),
 marked AS (SELECT *, anomaly AND row_number() OVER (PARTITION BY key, anomaly ORDER BY index_name, source, seq) = 1 AS kept FROM scored)"""


def _scored_sql(where: str = "true", index: str = "index_name", of_model: str = "true") -> str:
    return "WITH " + _SCORED.format(lines=LINES, baseline=BASELINE, where=where, index=index, of_model=of_model)


_CONTEXTS = """, m AS (SELECT *, min(CASE WHEN anomaly THEN seq END) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next,
   list(md5(line)) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS back, list(md5(line)) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM marked),
 e AS (SELECT *, least(seq + 3, coalesce(next - 1, seq + 3)) AS until FROM m),
 f AS (SELECT *, max(CASE WHEN kept THEN until END) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e),
 g AS (SELECT *, CASE WHEN seq - 1 - coalesce(last, 0) < 12 THEN seq - 1 - coalesce(last, 0) ELSE 3 END AS take, coalesce(len(back), 0) AS nb FROM f WHERE kept)
 SELECT index_name, source, pos::BIGINT AS pos, round(distance, 6) AS distance, md5(line) AS line, CASE WHEN take > 0 THEN coalesce(array_to_string(back[nb - take + 1:nb], ','), '') ELSE '' END AS before,
   CASE WHEN until > seq THEN coalesce(array_to_string(ahead[1:until - seq], ','), '') ELSE '' END AS after FROM g"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("index_name", "source", "pos", F.round("distance", 6).alias("distance"), F.md5(F.col("line").cast("binary")).alias("line"), _said("before").alias("before"), _said("after").alias("after"))


@query(_scored_sql() + _CONTEXTS)
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Anomalies of all target lines with their contexts: first per key, score, threshold, report-wide dedupe."""
    target, baseline = _sources(spark, sf)
    return _shown(reports.anomalies(_on(target, baseline, True)[0]))


@query(None)
def report_lines_tokens(spark: SparkSession, sf: str) -> DataFrame:
    target, baseline = _sources(spark, sf)
    return _shown(reports.anomalies(_on(target, baseline, False)[0]))


@query(_scored_sql() + " SELECT count(*) AS line_count, count(*) FILTER (WHERE kept) AS anomaly_count, count(*) FILTER (WHERE anomaly) AS repeated_count FROM marked")
def report_totals(spark: SparkSession, sf: str) -> DataFrame:
    scored, _ = _on(*_sources(spark, sf), True)
    return scored.agg(F.count("*").alias("line_count"), F.count(F.when(F.col("kept"), 1)).alias("anomaly_count"), F.count(F.when(F.col("anomaly"), 1)).alias("repeated_count"))


@query(_scored_sql() + """ SELECT index_name, source, count(*) AS line_count, sum(strlen(line))::BIGINT AS byte_count, count(*) FILTER (WHERE kept) AS n_anomalies, round(avg(distance) FILTER (WHERE kept), 6) AS mean_distance
 FROM marked GROUP BY index_name, source HAVING count(*) FILTER (WHERE kept) > 0""")
def report_sources(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each source with anomalies."""
    scored, _ = _on(*_sources(spark, sf), True)
    per = reports.log_reports(scored, scored.where("kept"))
    return per.select("index_name", "source", "line_count", "byte_count", "n_anomalies", F.round("mean_distance", 6).alias("mean_distance"))


@query(_scored_sql(where=f"NOT regexp_matches(line, '{IGNORED}')") + _CONTEXTS)
def report_ignored_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """The same where the configuration ignores some lines, before anything is tokenised."""
    target, baseline = _sources(spark, sf)
    return _shown(reports.anomalies(_on(target, baseline, True, SETTING)[0]))


@query(_scored_sql(index="'en'", of_model="index_name = 'en'") + " SELECT index_name, count(*) AS line_count, count(*) FILTER (WHERE kept) AS anomaly_count FROM marked GROUP BY index_name")
def single_index_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A model of one index is used for sources of every name."""
    target, baseline = _sources(spark, sf)
    scored, _ = _on(target, baseline.where("index_name = 'en'"), True)
    return scored.groupBy("index_name").agg(F.count("*").alias("line_count"), F.count(F.when(F.col("kept"), 1)).alias("anomaly_count"))


@query(_scored_sql() + " , c AS (SELECT index_name, count(DISTINCT source) AS n_sources, count(*) AS line_count, sum(strlen(line))::BIGINT AS byte_count, round(sum(strlen(line)) / 1048576.0, 6) AS mb FROM keyed WHERE base GROUP BY index_name) SELECT c.*, n.samples FROM c JOIN (SELECT index_name, count(*) AS samples FROM b GROUP BY index_name) n USING (index_name)")
def model_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What the model dump says of each index: sources, lines, bytes, samples."""
    _, baseline = _sources(spark, sf)
    model = reports.train(baseline, tokens=F.col("line"))
    return model.meta.select("index_name", F.size("sources").cast("long").alias("n_sources"), "line_count", "byte_count", F.round(reports.megabytes(F.col("byte_count")), 6).alias("mb"), "samples")


def _models_of(spark: SparkSession, sf: str) -> list[reports.Model]:
    _, baseline = _sources(spark, sf)
    return [reports.train(baseline.where(F.col("source").startswith(s + "/")), tokens=F.col("line")) for s in BASELINE]


@query(f"""WITH {LINES}, w AS (SELECT index_name, source, doc_id, line, list_sort(list_distinct(list_filter(string_split(line, ' '), lambda w: w <> ''))) AS words,
  array_to_string(list_sort(list_filter(string_split(line, ' '), lambda w: w NOT LIKE '\\%%' ESCAPE '\\')), ' ') AS key, pos FROM lines WHERE source IN {BASELINE}),
 f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY source, index_name, key ORDER BY source || '/doc-' || doc_id || '.log', pos) = 1)
 SELECT index_name, (SELECT count(DISTINCT words) FROM f g WHERE g.index_name = w.index_name) AS samples, count(*) AS line_count, sum(strlen(line))::BIGINT AS byte_count, count(DISTINCT doc_id) AS n_sources FROM w GROUP BY index_name""")
def model_merge_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Five models, one a baseline, merged: distinct rows, summed counters, all sources."""
    merged = reports.merge(*_models_of(spark, sf))
    return merged.meta.select("index_name", "samples", "line_count", "byte_count", F.size("sources").cast("long").alias("n_sources"))


@query(f"WITH {LINES} SELECT index_name, count(DISTINCT source || doc_id) AS n_sources, min(source || '/doc-' || doc_id || '.log') AS first_source FROM lines WHERE source IN {BASELINE} GROUP BY index_name")
def source_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Which sources make up each index."""
    _, baseline = _sources(spark, sf)
    held = baseline.groupBy("index_name").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return held.select("index_name", F.size("sources").cast("long").alias("n_sources"), F.element_at("sources", 1).alias("first_source"))


@query(_scored_sql() + """, r AS (SELECT source, avg(distance) FILTER (WHERE kept) AS m FROM marked GROUP BY source HAVING count(*) FILTER (WHERE kept) > 0),
 n AS (SELECT CASE WHEN source LIKE 'src6/%' THEN replace(source, '/doc-', '/job-output-') ELSE source END AS source, m FROM r)
 SELECT source, row_number() OVER (ORDER BY CASE WHEN source LIKE '%/job-output%' THEN 42.0 ELSE round(m, 9) END DESC, source) AS rank FROM n""")
def report_order(spark: SparkSession, sf: str) -> DataFrame:
    """The order of the reports: job outputs (here those of src6) first, then by mean distance."""
    from pyspark.sql import Window

    scored, _ = _on(*_sources(spark, sf), True)
    per = reports.log_reports(scored, scored.where("kept"))
    source = F.when(F.col("source").startswith("src6/"), F.replace("source", F.lit("/doc-"), F.lit("/job-output-"))).otherwise(F.col("source"))
    per = per.select(source.alias("source"), reports.sort_value(source, F.round("mean_distance", 9)).alias("sort"))
    return per.select("source", F.row_number().over(Window.orderBy(F.desc("sort"), "source")).cast("long").alias("rank"))


@query(_scored_sql() + _CONTEXTS.replace("SELECT index_name, source, pos::BIGINT AS pos, round(distance, 6) AS distance, md5(line) AS line,", "SELECT source, pos, len(").split("CASE WHEN take > 0")[0].rsplit("SELECT source, pos, len(", 1)[0] + """,
 w AS (SELECT source, seq, pos, least(take, nb) AS n_before, until - seq AS room, (SELECT count(*) FROM marked k WHERE k.source = g.source AND k.seq > g.seq AND k.seq <= g.until) AS n_after FROM g)
 SELECT source, pos::BIGINT AS pos, coalesce(lag(pos + n_after) OVER (PARTITION BY source ORDER BY seq) + 1 < pos - n_before, false) AS gap FROM w""")
def report_separators(spark: SparkSession, sf: str) -> DataFrame:
    """Where a separator stands between two contexts of a source."""
    scored, _ = _on(*_sources(spark, sf), True)
    return reports.with_separators(reports.anomalies(scored)).select("source", "pos", "gap")


@query(_scored_sql() + " SELECT index_name, source, pos::BIGINT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY index_name, source, seq) AS r FROM marked WHERE kept) WHERE r = 1")
def display_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Each raw line once."""
    scored, _ = _on(*_sources(spark, sf), True)
    return reports.first_lines(scored.where("kept")).select("index_name", "source", "pos")


# similarity: the lines of four sources are the anomalies of four reports
_TARGETS = ("src6", "src7", "src8", "src9")
_HELD = f"""WITH {LINES}, a AS (SELECT list_position({list(_TARGETS)}, source) - 1 AS target, index_name, source || '/doc-' || doc_id || '.log' AS source, pos, line FROM lines WHERE source IN {_TARGETS}),
 own AS (SELECT index_name, line, min(target) AS first FROM a GROUP BY ALL),
 o AS (SELECT a.index_name, a.line, a.target, min(a.source) AS source FROM a JOIN own ON a.index_name = own.index_name AND a.line = own.line AND a.target = own.first GROUP BY ALL),
 h AS (SELECT index_name, line, target, source FROM o UNION SELECT a.index_name, a.line, a.target, a.source FROM a JOIN own ON a.index_name = own.index_name AND a.line = own.line AND a.target > own.first)"""


def _shared(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.shared(_anomalies(spark, sf))


def _anomalies(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf).where(F.col("source").isin(*_TARGETS))
    target = F.array_position(F.array(*(F.lit(t) for t in _TARGETS)), F.col("source")) - 1
    return lines.select(target.alias("target"), "index_name", F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".log")).alias("source"), F.col("pos").cast("long").alias("pos"), F.col("line").alias("tokens"), "line")


@query(_HELD + " SELECT index_name, md5(line) AS line, count(*) AS n_holders, min(target) AS first_target, md5(string_agg(target || ':' || source, ',' ORDER BY target, source)) AS holders FROM h GROUP BY index_name, line")
def similarity_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Each anomaly once, with the sources that share it."""
    held = F.array_join(F.transform("holders", lambda x: F.concat(x["target"].cast("string"), F.lit(":"), x["source"])), ",")
    return _shared(spark, sf).select("index_name", F.md5(F.col("line").cast("binary")).alias("line"), F.size("holders").cast("long").alias("n_holders"), F.col("target").alias("first_target"), F.md5(held.cast("binary")).alias("holders"))


@query(_HELD + """, s AS (SELECT DISTINCT index_name, line, target FROM h), t AS (SELECT target, count(*) AS total FROM s GROUP BY target)
 SELECT a.target AS t1, b.target AS t2, count(*) AS shared, round(count(*) * 100 / any_value(t.total)::DOUBLE, 6) AS percent FROM s a JOIN s b ON a.index_name = b.index_name AND a.line = b.line AND a.target < b.target JOIN t ON t.target = b.target GROUP BY 1, 2""")
def similarity_percent(spark: SparkSession, sf: str) -> DataFrame:
    """What part of a target's anomalies an earlier one has too."""
    return similarity.percents(_shared(spark, sf)).select("t1", "t2", "shared", F.round(F.col("percent").cast("double"), 6).alias("percent"))


@query(_HELD + " SELECT target, count(*) AS total FROM (SELECT DISTINCT index_name, line, target FROM h) GROUP BY target")
def similarity_totals(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.totals(_shared(spark, sf))


@query(_HELD + " SELECT index_name, count(DISTINCT target || source) AS n_sources, count(DISTINCT line) AS n_anomalies FROM a GROUP BY index_name ORDER BY n_sources DESC, index_name")
def similarity_order(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.similarity_reports(_anomalies(spark, sf))


def _top_sql(order: str) -> str:
    return _HELD + f""", c AS (SELECT index_name, line, count(*) AS n_sources, min(source) FILTER (WHERE target = f) AS first_source FROM (SELECT *, min(target) OVER (PARTITION BY index_name, line) AS f FROM h) GROUP BY index_name, line ORDER BY n_sources {order}, index_name, line LIMIT 100)
 SELECT n_sources, index_name, first_source, md5(line) AS line FROM c QUALIFY row_number() OVER (PARTITION BY line ORDER BY index_name) = 1"""


def _top(spark: SparkSession, sf: str, least: bool) -> DataFrame:
    return similarity.top(_shared(spark, sf), least).withColumn("line", F.md5(F.col("line").cast("binary")))


@query(_top_sql("DESC"))
def most_common(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, False)


@query(_top_sql("ASC"))
def least_common(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, True)


# filtering: what reports of src6 and src7 know is taken out of a report of src8 and src9
@query(f"""WITH {LINES}, k AS (SELECT row_number() OVER () AS b, * FROM (SELECT DISTINCT index_name, list_sort(list_distinct(list_filter(string_split(line, ' '), lambda w: w <> ''))) AS words FROM lines WHERE source IN ('src6', 'src7') AND index_name <> 'fr')),
 a AS (SELECT index_name, doc_id, pos, line, list_sort(list_distinct(list_filter(string_split(line, ' '), lambda w: w <> ''))) AS words FROM lines WHERE source IN ('src8', 'src9')),
 d AS (SELECT row_number() OVER () AS t, * FROM (SELECT DISTINCT index_name, words FROM a)),
 c AS (SELECT t, b, count(*) AS c FROM (SELECT t, index_name, unnest(words) AS w FROM d) JOIN (SELECT b, index_name, unnest(words) AS w FROM k) USING (index_name, w) GROUP BY t, b),
 s AS (SELECT t, max(c / sqrt(len(d.words)::DOUBLE * len(k.words))) AS s FROM c JOIN d USING (t) JOIN k USING (b) GROUP BY t)
 SELECT a.index_name, doc_id, pos::BIGINT AS pos FROM a JOIN d ON a.index_name = d.index_name AND a.words = d.words LEFT JOIN s USING (t) WHERE a.index_name NOT IN (SELECT index_name FROM k) OR 1 - coalesce(s, 0) > 0.3""")
def filter_known_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Anomalies that no earlier report has; those of an index without earlier reports (here fr) all pass."""
    lines = _lines(spark, sf).withColumn("before", F.array().cast("array<string>"))
    earlier = lines.where(F.col("source").isin("src6", "src7") & (F.col("index_name") != "fr"))
    left = known.filter_reports(earlier, lines.where(F.col("source").isin("src8", "src9")), F.col("line"))
    return left.select("index_name", "doc_id", F.col("pos").cast("long").alias("pos"))


def _event_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Event lines; each user is a source, every fourth of them the output of a job."""
    name = F.concat(F.lit("/logs/"), F.when(F.col("user_id") % 4 == 0, "job-output").otherwise("service"), F.lit("-"), F.col("user_id").cast("string"), F.lit(".txt"))
    return _event_lines(spark, sf).select(F.lit("service").alias("index_name"), name.alias("source"), F.col("event_id").alias("seq"), F.col("event_id").alias("pos"), "line")


@query(f"""WITH {EVENTS}, e AS (SELECT '/logs/' || CASE WHEN user_id % 4 = 0 THEN 'job-output' ELSE 'service' END || '-' || user_id || '.txt' AS source, user_id, event_id AS pos, line, regexp_replace(line, '[0-9]', '', 'g') AS key FROM event_lines WHERE {IS_ERROR})
 SELECT source, pos, md5(line) AS line FROM e WHERE user_id % 4 = 0 UNION ALL SELECT source, pos, md5(line) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, pos) AS r FROM e WHERE user_id % 4 <> 0) WHERE r = 1""")
def errors_report(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of all sources; outside job outputs only the first of its kind (here: equal but for digits)."""
    key = F.regexp_replace("line", "[0-9]", "")
    return known.errors_report(_event_sources(spark, sf), key=key).select("source", "pos", F.md5(F.col("line").cast("binary")).alias("line"))


@query(None)
def fresh_errors_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The errors of odd users that are not known from those of even ones; where k is under 50, the former run a service that the latter do not."""
    lines = _event_sources(spark, sf).withColumn("odd", F.regexp_extract("source", "-([0-9]+)", 1).cast("long") % 2 == 1)
    other = F.regexp_extract("line", '"k": ?([0-9]+)', 1).cast("int") < 50
    changed = F.regexp_replace("line", "svc .*\\}", "kernel watchdog restarted overlay network mounts elsewhere")
    target = lines.where("odd").withColumn("line", F.when(other, changed).otherwise(F.col("line")))
    found = known.report_errors(target.drop("odd"), lines.where("not odd").drop("odd"))
    return found.select("source", "pos", F.md5(F.col("line").cast("binary")).alias("line"))


@query(f"""WITH {EVENTS}, e AS (SELECT user_id, event_id, epoch_ms(strptime(substr(line, 1, 23), '%Y-%m-%d %H:%M:%S,%g')) AS ts_ms FROM event_lines WHERE {IS_ERROR})
 SELECT event_id, ts_ms, row_number() OVER (ORDER BY ts_ms, user_id, event_id) AS place FROM e""")
def timeline_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The errors of all sources in one order of time (the query numbers them, so that the order can be checked)."""
    from pyspark.sql import Window

    from ..operators import errors

    lines = _event_lines(spark, sf).select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("seq"), F.col("event_id").alias("pos"), "line")
    found = errors.error_contexts(lines).withColumn("index_name", F.lit("service")).withColumn("seq", F.col("pos"))
    ordered = reports.timeline(found).select(F.col("pos").alias("event_id"), "ts_ms", F.col("source").cast("long").alias("user"))
    return ordered.select("event_id", "ts_ms", F.row_number().over(Window.orderBy("ts_ms", "user", "event_id")).cast("long").alias("place"))


@query(None)
def report_json(spark: SparkSession, sf: str) -> DataFrame:
    """Each anomaly of the report as a JSON document."""
    from ..sinks import store

    target, baseline = _sources(spark, sf)
    return store.as_json(reports.anomalies(_on(target, baseline, True)[0]))


@query("SELECT a.conv_id, a.turn, coalesce(string_agg(md5(coalesce(b.text, '')), ',' ORDER BY b.turn) FILTER (WHERE b.turn IS NOT NULL), '') AS after FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn <= a.turn + 3 GROUP BY ALL")
def context_after(spark: SparkSession, sf: str) -> DataFrame:
    """The three turns that follow each turn of a conversation."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(1, 3)
    ahead = F.collect_list(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).over(order)
    return _table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(ahead, ",").alias("after"))

"""WARC revisits: not-modified captures resolved to the response they refer to; DataFrame operations only.

A revisit is joined, as of its time, to the latest earlier full response of the same canonical URL.  All
records are dealt by ranges of (URL, time), so that a URL with most of the captures, even of one second, is
spread over many ranges; the join is a running last value inside (URL, range), and a carry of the last
response from range to range, which has one row for each: the window that must see a whole URL sees
ranges, not captures.  Bodies do not take part; the resolved row names the response and its digest.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Header fields that a 304 answer may update; all others stay as first stored.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical(url: Column) -> Column:
    """Host in lower case without www., no scheme, default port, fragment, tracking parameters or trailing slash."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z]+://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z]+://[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&", -1), lambda p: (p != "") & ~p.rlike("^utm_")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit: (record_id, key, ts, state, response_id, digest, headers).

    records: record_id long, url string, ts long (seconds), kind 'response' or 'revisit', digest string,
    headers map<string,string> with lower-case names.  state is 'resolved'; 'changed' where both sides
    have an etag, or else a last-modified, and these differ; 'unchecked' where no validator is on both;
    'orphan' without an earlier response.  headers are the response's, with the permitted ones of
    the revisit merged in where it is resolved or unchecked, else null.  Of responses at one time the
    largest record_id is the latest; only strictly earlier times count.  Records without a time or
    with another kind are ignored, a null url is the key ''.  Repeated revisits each give a row; a null
    record_id counts as the smallest; further columns are ignored; an empty table gives an empty one.
    """
    rows = records.where("ts is not null and kind in ('response', 'revisit')").select(
        "record_id", canonical(F.col("url")).alias("key"), F.col("ts").cast("long").alias("ts"), "kind", "digest", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers")
    )
    dealt = rows.repartitionByRange("key", "ts", "kind", "record_id").withColumn("block", F.spark_partition_id())
    rows = Scratch(records.sparkSession, "warc").put(dealt, "dealt")  # written, so that a repeated task finds the same ranges
    response = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "digest", "headers"))
    inside = Window.partitionBy("key", "block").orderBy("ts", F.struct(F.col("kind") == "response"), "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("near", F.last(response, ignorenulls=True).over(inside)).where("kind = 'revisit'")
    # revisits sort before responses of the same second, so the last value is strictly earlier

    ends = rows.groupBy("key", "block").agg(F.max_by(response, F.when(F.col("kind") == "response", F.struct("ts", "record_id"))).alias("end"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(before)).select("key", "block", "carried")
    found = near.join(carried, ["key", "block"], "left").withColumn("r", F.coalesce("near", "carried"))

    def differs(name: str) -> Column:
        return F.element_at("headers", F.lit(name)) != F.element_at("r.headers", F.lit(name))

    same = F.coalesce(~differs("etag"), ~differs("last-modified"))
    state = F.when(F.col("r").isNull(), "orphan").when(same, "resolved").when(same.isNull(), "unchecked").otherwise("changed")
    own = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("r.headers", lambda k, v: ~F.map_contains_key(own, k)), own)
    out = found.withColumn("state", state)
    good = F.col("state").isin("resolved", "unchecked")
    return out.select("record_id", "key", "ts", "state", F.when(good, F.col("r.record_id")).alias("response_id"), F.when(good, F.col("r.digest")).alias("digest"), F.when(good, merged).alias("headers"))


def records_of(data: bytes) -> Iterator[tuple[str, str, dict[str, str], dict[str, str]]]:
    """(record id, type, WARC headers, HTTP headers) of the records of a WARC file, plain or gzip by record; names in lower case."""
    file = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)

    def fields(block: bytes) -> dict[str, str]:
        out = {}
        for line in block.decode(errors="replace").split("\r\n")[1:]:
            name, sign, value = line.partition(":")
            if sign:
                out[name.strip().lower()] = value.strip()
        return out

    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = line
        while (line := file.readline()).strip():
            head += line
        own = fields(head)
        body = file.read(int(own.get("content-length", 0)))
        http = body.split(b"\r\n\r\n", 1)[0] if own.get("content-type", "").startswith("application/http") else b""
        yield own.get("warc-record-id", ""), own.get("warc-type", ""), own, fields(http)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The responses and revisits of WARC files as records for ``resolve_revisits``; one file is one row of a task.

    record_id is a hash of the record's own id.  A file or record that cannot be read ends that file; what came before counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for data in batch.column(0):
                out: list[tuple] = []
                try:
                    for name, kind, own, http in records_of(data.as_py()):
                        if kind in ("response", "revisit") and "warc-date" in own:
                            ts = int(datetime.fromisoformat(own["warc-date"]).timestamp())
                            out.append((name, own.get("warc-target-uri"), ts, kind, own.get("warc-payload-digest"), list(http.items())))
                except (OSError, EOFError, ValueError):
                    pass
                if out:
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), headers)
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["name", "url", "ts", "kind", "digest", "headers"])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(run, "name string, url string, ts long, kind string, digest string, headers map<string,string>")
    return rows.select(F.xxhash64("name").alias("record_id"), "url", "ts", "kind", "digest", "headers")


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of the pages table, as a crawler would have left them.

    Each page is a full response at second 10 * page_id with the digest as etag; 7 seconds and a day later it
    is visited again and not modified.  Every fifth page's second answer has another etag, every seventh
    only a date, and every eleventh page's response is missing.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    base = pages.select("page_id", "url", digest.alias("digest"))
    date = lambda c: F.concat(F.lit("t"), c.cast("string"))
    at = F.col("page_id") * 10
    full = base.where("page_id % 11 <> 0").select(
        (F.col("page_id") * 3).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), "digest",
        F.create_map(F.lit("date"), date(at), F.lit("etag"), F.substring("digest", 1, 16), F.lit("content-type"), F.lit("text/html")).alias("headers"),
    )

    def again(number: int, later: int) -> DataFrame:
        when = at + later
        tag = F.when(F.col("page_id") % 5 == 0, F.lit("other")).otherwise(F.substring("digest", 1, 16)) if number == 2 else F.substring("digest", 1, 16)
        dated = F.create_map(F.lit("date"), date(when), F.lit("server"), F.lit("cache"))
        tagged = F.create_map(F.lit("date"), date(when), F.lit("server"), F.lit("cache"), F.lit("etag"), tag)
        return base.select(
            (F.col("page_id") * 3 + number).alias("record_id"), "url", when.alias("ts"), F.lit("revisit").alias("kind"), F.lit(None).cast("string").alias("digest"), F.when(F.col("page_id") % 7 == 0, dated).otherwise(tagged).alias("headers")
        )

    return full.unionByName(again(1, 7)).unionByName(again(2, 86400))


#: The same over pages in DuckDB, by a plain as-of window.
ORACLE = """
WITH base AS (
  SELECT page_id, regexp_replace(coalesce(url, ''), '#.*$', '') AS bare, sha256(coalesce(html, '')) AS digest FROM pages
), split AS (
  SELECT page_id, digest,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z]+://([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(bare, '^[A-Za-z]+://[^/?]*', '') AS rest FROM base
), keyed AS (
  SELECT page_id, digest, host || regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') ||
    CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^utm_'))) AS q FROM split)
), records AS (
  SELECT page_id * 3 AS record_id, key, page_id * 10 AS ts, 1 AS kind, digest, substr(digest, 1, 16) AS etag FROM keyed WHERE page_id % 11 <> 0
  UNION ALL SELECT page_id * 3 + 1, key, page_id * 10 + 7, 0, NULL, CASE WHEN page_id % 7 <> 0 THEN substr(digest, 1, 16) END FROM keyed
  UNION ALL SELECT page_id * 3 + 2, key, page_id * 10 + 86400, 0, NULL, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 'other' ELSE substr(digest, 1, 16) END FROM keyed
), joined AS (
  SELECT *, last_value(CASE WHEN kind = 1 THEN {'ts': ts, 'id': record_id, 'digest': digest, 'etag': etag} END IGNORE NULLS)
    OVER (PARTITION BY key ORDER BY ts, kind, record_id ROWS UNBOUNDED PRECEDING) AS r FROM records
), judged AS (
  SELECT *, CASE WHEN r IS NULL THEN 'orphan' WHEN etag = r.etag THEN 'resolved' WHEN etag IS NULL THEN 'unchecked' ELSE 'changed' END AS state FROM joined WHERE kind = 0
)
SELECT record_id, key, ts::BIGINT AS ts, state, CASE WHEN state IN ('resolved', 'unchecked') THEN r.id END AS response_id,
  CASE WHEN state IN ('resolved', 'unchecked') THEN r.digest END AS digest,
  CASE WHEN state IN ('resolved', 'unchecked') THEN 'content-type=text/html,date=t' || ts || ',etag=' || coalesce(etag, r.etag) END AS headers
FROM judged
"""


def digests(result: DataFrame) -> DataFrame:
    """The operator's rows with the headers as sorted text."""
    said = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return result.withColumn("headers", said)

"""Build records of CI services as columns: decoding, manifests, baseline discovery."""

from __future__ import annotations

import json
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMMON = (
    "uuid string, job_name string, result string, start_time string, end_time string, duration double, voting boolean, log_url string,"
    " artifacts array<struct<name:string,url:string>>, pipeline string, event_id string"
)
_CHANGE = "project string, branch string, change bigint, patchset string, ref_url string, ref string"
LEGACY = f"struct<{_COMMON.replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean').replace(' array', ':array')},{_CHANGE.replace(' string', ':string').replace(' bigint', ':bigint')}>"
NEW = LEGACY.split(",project:")[0] + f",ref:struct<{_CHANGE.replace(' string', ':string').replace(' bigint', ':bigint')}>>"
DISTINCT_LEGACY = ("project", "branch", "change", "patchset", "ref_url")
REQUIRED = ("uuid", "job_name", "result", "start_time", "end_time", "duration", "voting", "pipeline", "artifacts", "project", "branch", "ref")
JOB_HISTORY = "(?m)^[ \\t]*var allBuilds = (.*?);*[ \\t\\r]*$"


def _utc(x: Column) -> Column:
    """A time that may lack its Z."""
    return F.try_to_timestamp(F.concat(F.regexp_replace(x, "Z$", ""), F.lit("Z")))


def decode_build(text: Column) -> Column:
    """One struct for either record format; null for what lacks a required field or has no place in the format."""
    old, new = F.from_json(text, LEGACY), F.from_json(text, NEW)

    def field(name: str) -> Column:
        if name in DISTINCT_LEGACY or name == "ref":
            return F.coalesce(new["ref"][name], old[name]) if name != "ref" else F.coalesce(new["ref"]["ref"], old["ref"])
        return old[name]

    out = {n: field(n) for n in (*(c.split()[0] for c in _COMMON.split(", ") if c), "project", "branch", "change", "patchset", "ref_url", "ref")}
    whole = F.lit(True)
    for n in REQUIRED:
        whole = whole & out[n].isNotNull()
    out["start_time"], out["end_time"] = _utc(out["start_time"]), _utc(out["end_time"])
    out["duration"] = out["duration"].cast("long")
    return F.when(whole & out["start_time"].isNotNull() & out["end_time"].isNotNull(), F.struct(*(c.alias(n) for n, c in out.items())))


def decode_builds(pages: DataFrame, column: str) -> DataFrame:
    """The builds of JSON arrays, one row each; what does not decode is left out."""
    items = F.from_json(F.col(column), "array<string>")
    return pages.select(F.explode(items).alias("item")).select(decode_build(F.col("item")).alias("b")).where("b is not null").select("b.*")


def baseline_score(build: dict, today: Column) -> Column:
    """How good a baseline a decoded build is for ``build`` (project, change, ref_url, branch); null without URLs."""
    same_change = (F.col("change") == F.lit(build["change"])) | (F.col("ref_url") == F.lit(build["ref_url"]))
    project = F.when(F.col("project") != F.lit(build["project"]), 0).when(F.coalesce(same_change, F.lit(False)), -500).otherwise(50)
    branch = F.when(F.col("branch") == F.lit(build["branch"]), 50).otherwise(0)
    gate = F.when(F.col("pipeline").contains("gate") | F.col("pipeline").contains("periodic"), 50).otherwise(0)
    age = elapsed_days(F.col("end_time"), today)
    score = project + branch + gate + F.when(F.col("voting"), 10).otherwise(0) - age
    return F.when(F.col("log_url").isNotNull() & F.col("ref_url").isNotNull(), score)


def elapsed_days(since: Column, today: Column) -> Column:
    return F.greatest(F.datediff(today, F.to_date(since)), F.lit(0))


def discover(builds: DataFrame, build: dict, today: Column) -> DataFrame:
    """The best baseline: highest score, then first uuid; never the build itself."""
    scored = builds.withColumn("score", baseline_score(build, today)).where(F.col("score").isNotNull() & (F.col("uuid") != F.lit(build["uuid"])))
    return scored.orderBy(F.desc("score"), "uuid").limit(1)


def first_success(history: DataFrame, among: int = 200) -> DataFrame:
    """The first successful build of the newest ``among``; history has place (0 is newest) and result."""
    return history.where((F.col("place") < among) & (F.col("result") == "SUCCESS")).orderBy("place").limit(1)


def job_history(page: Column) -> Column:
    """array<struct<ID, Result>> of the builds that a job's history page carries in its script; null without them."""
    found = F.regexp_extract(page, JOB_HISTORY, 1)
    return F.from_json(F.nullif(found, F.lit("")), "array<struct<ID:string,Result:string,SpyglassLink:string,Started:string,Duration:bigint>>")


def flatten_manifest(text: str, base: str) -> list[str]:
    """The file URLs of a manifest tree in page order; names are percent-encoded."""
    todo = [(node, base if base.endswith("/") else base + "/") for node in reversed(json.loads(text)["tree"])]
    out = []
    while todo:
        node, at = todo.pop()
        name = quote(node["name"], safe="")
        if node["mimetype"] == "application/directory":
            todo += [(child, f"{at}{name}/") for child in reversed(node.get("children", []))]
        else:
            out.append(at + name)
    return out


def manifest_urls(text: Column, base: Column) -> Column:
    """array<string> of the same; null where the manifest does not parse."""

    def run(texts: pa.Array, bases: pa.Array) -> pa.Array:
        out = []
        for t, b in zip(texts.to_pylist(), bases.to_pylist(), strict=True):
            try:
                out.append(flatten_manifest(t, b))
            except (ValueError, KeyError, TypeError):
                out.append(None)
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text, base)


def from_inventory(inventory: dict, api_base: str) -> dict:
    """The build that a job's inventory (parsed YAML) describes."""
    zuul = inventory["all"]["vars"]["zuul"]
    api = f"{api_base}api/tenant/{zuul['tenant']}/"
    return {
        "api": api, "uuid": zuul["build"], "job_name": zuul["job"], "project": zuul["project"]["name"], "branch": zuul["branch"], "result": "FAILED",
        "pipeline": zuul["pipeline"], "log_url": f"{api}build/{zuul['build']}", "ref_url": zuul["change_url"], "change": 0,
    }

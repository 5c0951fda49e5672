"""Models and reports on disk: Parquet with a small metadata file that names the format."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import Model, Report

MAGIC, VERSION = "DRFT", 1


class BadModel(ValueError):
    """The folder holds no model of this format: train again."""


def _meta(spark: SparkSession, path: str) -> dict:
    try:
        rows = spark.read.text(f"{path}/_meta_model").collect()
        meta = json.loads("".join(r.value for r in rows))
    except Exception as problem:
        raise BadModel(f"{path}: no model metadata") from problem
    if meta.get("magic") != MAGIC or meta.get("version") != VERSION:
        raise BadModel(f"{path}: {meta.get('magic')} version {meta.get('version')}")
    return meta


def save_model(model: Model, path: str, created_ms: int) -> None:
    """Rows by index name (one folder an index), counters, and last the metadata, without which the rest is no model."""
    path = path.rstrip("/")
    model.rows.write.mode("overwrite").partitionBy("index_name").parquet(f"{path}/rows")
    model.meta.write.mode("overwrite").parquet(f"{path}/meta")
    spark = model.rows.sparkSession
    text = json.dumps({"magic": MAGIC, "version": VERSION, "created_ms": created_ms})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta_model")


def check_model(spark: SparkSession, path: str) -> int:
    """When the model was made (milliseconds); BadModel if there is none of this format."""
    return _meta(spark, path.rstrip("/"))["created_ms"]


def load_model(spark: SparkSession, path: str) -> Model:
    path = path.rstrip("/")
    check_model(spark, path)
    rows = spark.read.schema("words array<string>, index_name string").parquet(f"{path}/rows")
    return Model(rows.select("index_name", "words"), spark.read.parquet(f"{path}/meta"))


def save_report(report: Report, path: str, form: str = "parquet") -> None:
    """Each table of a report as Parquet or JSON lines under ``path``."""
    for name in ("anomalies", "log_reports", "unknown_files", "read_errors", "totals"):
        getattr(report, name).write.mode("overwrite").format(form).save(f"{path.rstrip('/')}/{name}")


def load_report(spark: SparkSession, path: str) -> Report:
    tables = (spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in ("anomalies", "log_reports", "unknown_files", "read_errors", "totals"))
    return Report(*tables)


def as_json(found: DataFrame) -> DataFrame:
    """(index_name, source, json): one document an anomaly."""
    return found.select("index_name", "source", F.to_json(F.struct(*found.columns)).alias("json"))


def as_text(found: DataFrame) -> DataFrame:
    """(index_name, source, seq, text): an anomaly as it is printed: ``distance * 99`` in two digits, number, line; context with 00."""

    def numbered(lines: Column, first: Column) -> Column:
        return F.transform(lines, lambda x, i: F.concat(F.lit("00 | "), F.lpad((first + i).cast("string"), 4, "0"), F.lit(" | "), x))

    score = F.lpad(F.floor(F.col("distance") * 99).cast("int").cast("string"), 2, "0")
    own = F.concat(score, F.lit(" | "), F.lpad(F.col("pos").cast("string"), 4, "0"), F.lit(" | "), "line")
    every = F.concat(numbered(F.col("before"), F.col("pos") - F.size("before")), F.array(own), numbered(F.col("after"), F.col("pos") + 1))
    return found.select("index_name", "source", "seq", F.array_join(every, "\n").alias("text"))

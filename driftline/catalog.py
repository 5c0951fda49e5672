"""Catalogs of reports and models: append-only tables, the latest row of an id counts.

Rows carry ``version``, the order in which they were appended, so nothing is updated in place; a writer that is
lost leaves whole rows or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REPORTS = "id long, created_at timestamp, updated_at timestamp, target string, baseline string, anomaly_count long, status string, bytes_size long, errors boolean, version long"
MODELS = "content_id string, model_version long, created_at timestamp, bytes_size long, errors boolean, version long"
MODEL_VERSION = 1
PENDING = "pending"
BATCH = 20


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """The last appended row of each key (a map-side maximum)."""
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), "version").alias("r"))
    return best.select("r.*")


def lookup_report(reports: DataFrame, target: str, baseline: str, errors: bool) -> DataFrame:
    """(id, status) of the report of a target against a baseline."""
    return latest(reports, "id").where((F.col("target") == target) & (F.col("baseline") == baseline) & (F.col("errors") == errors)).select("id", "status")


def newest(reports: DataFrame) -> DataFrame:
    return latest(reports, "id").orderBy(F.desc("id"))


def without_pending(reports: DataFrame) -> DataFrame:
    """What is left after a restart: reports that were under way are gone."""
    return latest(reports, "id").where(F.col("status") != PENDING)


def current_models(models: DataFrame, version: int = MODEL_VERSION) -> DataFrame:
    """Models of the present format; others are to be deleted."""
    return latest(models, "content_id", "errors").where(F.col("model_version") == version)


def reusable(models: DataFrame, older: Column) -> DataFrame:
    """Models that may be used again: their content is older than they are (``older`` over created_at)."""
    return current_models(models).where(older)


def bytes_used(*tables: DataFrame) -> DataFrame:
    sizes = tables[0].select("bytes_size")
    for t in tables[1:]:
        sizes = sizes.unionByName(t.select("bytes_size"))
    return sizes.agg(F.coalesce(F.sum("bytes_size"), F.lit(0)).alias("bytes_size"))


def reclaimed(rows: DataFrame, amount: int | Column, key: str = "id", batch: int = BATCH) -> DataFrame:
    """The oldest rows to delete to free ``amount`` bytes, in whole batches of ``batch`` rows.

    A batch is taken as long as the ones before it have not freed enough.  The window sees catalog rows, of which
    there is one for each report or model.
    """
    order = Window.orderBy("created_at", key)
    n = rows.withColumn("batch", F.floor((F.row_number().over(order) - 1) / batch))
    freed = n.groupBy("batch").agg(F.sum("bytes_size").alias("size"))
    before = F.sum("size").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
    needed = freed.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < amount).select("batch")
    return n.join(needed, "batch", "left_semi").drop("batch")


class Catalog:
    """Both tables under a folder, as Parquet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    @property
    def reports(self) -> DataFrame:
        return self._read("reports", REPORTS)

    @property
    def models(self) -> DataFrame:
        return self._read("models", MODELS)

    def _append(self, name: str, schema: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def initialize(self, target: str, baseline: str, errors: bool = False) -> int:
        """Add a pending report; its id."""
        last = self.reports.agg(F.max("id"), F.max("version")).first()
        new = (last[0] or 0) + 1
        now = self.spark.range(1).select(F.current_timestamp()).first()[0]
        self._append("reports", REPORTS, [(new, now, now, target, baseline, 0, PENDING, 0, errors, (last[1] or 0) + 1)])
        return new

    def update(self, report: int, anomaly_count: int, status: str, bytes_size: int) -> None:
        row = latest(self.reports, "id").where(F.col("id") == report).first()
        if row is None:
            raise KeyError(report)
        version = self.reports.agg(F.max("version")).first()[0] + 1
        now = self.spark.range(1).select(F.current_timestamp()).first()[0]
        self._append("reports", REPORTS, [(report, row.created_at, now, row.target, row.baseline, anomaly_count, status, bytes_size, row.errors, version)])

    def status(self, report: int) -> str | None:
        row = latest(self.reports, "id").where(F.col("id") == report).first()
        return row and row.status

    def add_model(self, content_id: str, bytes_size: int, errors: bool = False) -> None:
        version = (self.models.agg(F.max("version")).first()[0] or 0) + 1
        now = self.spark.range(1).select(F.current_timestamp()).first()[0]
        self._append("models", MODELS, [(content_id, MODEL_VERSION, now, bytes_size, errors, version)])

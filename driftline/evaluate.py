"""Accuracy on cases: a folder with ``inf.yaml``, one ``*.good`` log to train on and one ``*.fail`` log to score."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from .operators import reports, splitting


def _lines(spark: SparkSession, file: Path):
    docs = spark.createDataFrame([(file.name, file.read_text())], "source string, text string")
    return splitting.split(docs, "source", "text").selectExpr("'case' as index_name", "source", "seq", "pos", "line")


def case(spark: SparkSession, folder: str) -> list[str] | None:
    """What is wrong: expected lines (parts of lines, in order) that are no anomalies, then anomalies too many; None if skipped."""
    import yaml

    root = Path(folder)
    info = yaml.safe_load((root / "inf.yaml").read_text())
    if info.get("skip"):
        return None
    good, fail = (next(iter(sorted(root.glob(p)))) for p in ("*.good", "*.fail"))
    found = reports.anomalies(reports.score(_lines(spark, fail), reports.train(_lines(spark, good))))
    said = [r.line for r in found.orderBy("seq").select("line").collect()]
    wrong, at = [], 0
    for want in info["anomalies"]:
        place = next((k for k in range(at, len(said)) if want["line"] in said[k]), None)
        if place is None:
            wrong.append(f"missing: {want['line']}")
        else:
            at = place + 1
    if len(said) != len(info["anomalies"]):
        wrong.append(f"{len(said)} anomalies, {len(info['anomalies'])} expected")
    return wrong

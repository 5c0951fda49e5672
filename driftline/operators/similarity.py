"""Which anomalies several reports share.

Anomalies are (target, index_name, source, pos, tokens, line); target is the number of a report.  An anomaly is
known by its tokens within its index.  The first target that has it owns it; the sources of that
anomaly are the owner's own and those of all later targets that hold it (other sources of the owner are not).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 100


def sources(anomalies: DataFrame) -> DataFrame:
    """(index_name, source_id, target, source): the reports' sources, numbered from 0 within their index."""
    held = anomalies.select("index_name", "target", "source").distinct()
    order = Window.partitionBy("index_name").orderBy("target", "source")
    return held.withColumn("source_id", F.row_number().over(order) - 1)


def shared(anomalies: DataFrame) -> DataFrame:
    """(index_name, tokens, target, pos, line, holders): one row an anomaly, with (target, source) of each holder, sorted.

    Combined map-side; a line that all reports have is one row a report in its set.
    """
    first = F.min(F.struct("target", "source", "pos", "line")).alias("own")
    held = anomalies.groupBy("index_name", "tokens").agg(first, F.collect_set(F.struct("target", "source")).alias("all"))
    mine = F.struct(F.col("own.target").alias("target"), F.col("own.source").alias("source"))
    others = F.filter("all", lambda x: x["target"] > F.col("own.target"))
    return held.select("index_name", "tokens", F.col("own.target").alias("target"), F.col("own.pos").alias("pos"), F.col("own.line").alias("line"), F.array_sort(F.concat(F.array(mine), others)).alias("holders"))


def similarity_reports(anomalies: DataFrame) -> DataFrame:
    """(index_name, n_sources, n_anomalies), most sources first, then by name."""
    held = anomalies.groupBy("index_name").agg(F.count_distinct("target", "source").alias("n_sources"), F.count_distinct("tokens").alias("n_anomalies"))
    return held.orderBy(F.desc("n_sources"), "index_name")


def totals(found: DataFrame) -> DataFrame:
    """(target, total): anomalies that each target holds, of the shared table."""
    return found.select(F.explode(F.array_distinct(F.transform("holders", lambda x: x["target"]))).alias("target")).groupBy("target").agg(F.count("*").alias("total"))


def matrix(found: DataFrame) -> DataFrame:
    """(t1, t2, shared): anomalies in common, of each pair of targets t1 < t2."""
    sets = found.select(F.array_sort(F.array_distinct(F.transform("holders", lambda x: x["target"]))).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.posexplode("s").alias("i", "t1"), "s").select("t1", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("t2"))
    return pairs.groupBy("t1", "t2").agg(F.count("*").alias("shared"))


def percents(found: DataFrame) -> DataFrame:
    """(t1, t2, shared, percent): of the second target's anomalies, how many the first has too."""
    per = totals(found).withColumnRenamed("target", "t2")
    return matrix(found).join(F.broadcast(per), "t2").select("t1", "t2", "shared", (F.col("shared") * 100 / F.col("total")).alias("percent"))


def top(found: DataFrame, least: bool = False, n: int = TOP) -> DataFrame:
    """The ``n`` most (or least) common anomalies, each line once, by the source of its first holder."""
    count = F.size("holders").cast("long")
    some = found.withColumn("n_sources", count).orderBy(F.col("n_sources").asc() if least else F.col("n_sources").desc(), "index_name", "tokens").limit(n)
    one = F.row_number().over(Window.partitionBy("line").orderBy("index_name", "tokens"))  # of n rows
    return some.withColumn("r", one).where("r = 1").select("n_sources", "index_name", F.col("holders")[0]["source"].alias("first_source"), "line").orderBy("first_source", "index_name", "line")

"""Generated log lines: two to nine words of two to seventeen letters and digits, the same for a seed on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def lines(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(id, line), each line a function of its id and the seed."""
    draw = lambda below, *at: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), *at), F.lit(below)).cast("int")
    steps = lambda count: F.sequence(F.lit(1), count)

    def word(i: Column) -> Column:
        return F.array_join(F.transform(steps(draw(16, i, F.lit(0)) + 2), lambda j: F.substring(F.lit(LETTERS), draw(len(LETTERS), i, j) + 1, F.lit(1))), "")

    return spark.range(n).select("id", F.array_join(F.transform(steps(draw(8, F.lit(0)) + 2), word), " ").alias("line"))

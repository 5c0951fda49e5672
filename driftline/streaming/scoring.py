"""Scoring of a stream of lines against a fixed baseline, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import patterns as P
from ..functions import tokenizer
from ..operators import scoring


def score_stream(lines: DataFrame, baseline: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Write anomalous lines of a stream (index_name, line, further columns) as Parquet.

    baseline (index_name, words) is a trained model's rows; lines are tokenised and scored inside each micro-batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        words = tokenizer.with_tokens(batch).withColumn("words", scoring.word_set(F.col("tokens"))).drop("tokens")
        scored = scoring.distances(words, baseline).where(F.col("distance") > P.THRESHOLD)
        words.join(scored, ["index_name", "words"]).drop("words").write.mode("overwrite").parquet(f"{to}/batch={number}")

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

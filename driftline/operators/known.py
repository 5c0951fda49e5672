"""Errors reports, and anomalies that earlier reports or a model already know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import tokenizer, urls
from ..functions.config import TargetConfig
from . import errors, reports, scoring


def errors_report(lines: DataFrame, config: TargetConfig | None = None, key: Column | None = None) -> DataFrame:
    """(index_name, source, pos, line, before, after, ts_ms, distance) of all errors of all sources.

    lines as for reports.  Job outputs report every error, other sources the first of each key (a column over
    ``line``, the sorted tokens if not given).
    """
    config = config or TargetConfig()
    ignore = "|".join(f"(?:{p})" for p in config.ignore_patterns) or None
    names = lines.select("source", "index_name").distinct()
    output = urls.is_job_output(F.col("source"))
    plain = lines.select("source", "seq", "pos", "line")
    every = errors.error_contexts(plain.where(output), ignore)
    if config.dedupes:
        key = reports.dedupe_key(tokenizer.tokens_of(F.col("line"))) if key is None else key
        firsts = errors.error_contexts(plain.where(~output), ignore, key)
    else:
        firsts = errors.error_contexts(plain.where(~output), ignore)
    return every.unionByName(firsts).join(names, "source").select("index_name", "source", "pos", "line", "before", "after", "ts_ms", "distance")


def known_lines(found: DataFrame) -> DataFrame:
    """(index_name, line): the lines that reports know: anomalies, and for job outputs the lines before them too."""
    output = urls.is_job_output(F.col("source"))
    lines = found.select("index_name", F.explode(F.when(output, F.concat("before", F.array("line"))).otherwise(F.array("line"))).alias("line"))
    return lines.distinct()


def train_errors(lines: DataFrame, config: TargetConfig | None = None, tokens: Column | None = None) -> DataFrame:
    """(index_name, words): a model of the errors of baseline lines."""
    return index_of(known_lines(errors_report(lines, config)), tokens)


def index_of(lines: DataFrame, tokens: Column | None = None) -> DataFrame:
    tokenised = reports.with_tokens(lines, tokens)
    return tokenised.select("index_name", scoring.word_set(F.col("tokens")).alias("words")).distinct()


def fresh(found: DataFrame, known: DataFrame, tokens: Column | None = None) -> DataFrame:
    """The anomalies that ``known`` (index_name, words) does not cover.

    An anomaly is fresh if its line is farther than the threshold from all known lines of its index, or, for job
    outputs, if a line before it is.  Anomalies of an index that is not known pass.  ``found`` has index_name,
    source, line, before; further columns are kept.
    """
    found = found.withColumn("row", F.xxhash64("index_name", "source", "pos", "line"))
    output = urls.is_job_output(F.col("source"))
    names = known.select("index_name").distinct()
    judged = found.join(names, "index_name", "left_semi")
    asked = judged.select("row", "index_name", F.explode(F.when(output, F.concat("before", F.array("line"))).otherwise(F.array("line"))).alias("line"))
    asked = reports.with_tokens(asked, tokens).select("row", "index_name", scoring.word_set(F.col("tokens")).alias("words"))
    far = asked.join(scoring.distances(asked, known), ["index_name", "words"]).where(F.col("distance") > P.THRESHOLD).select("row").distinct()
    new = judged.join(far, "row", "left_semi")
    return new.unionByName(found.join(names, "index_name", "left_anti").select(new.columns)).drop("row")


def filter_reports(baselines: DataFrame, target: DataFrame, tokens: Column | None = None) -> DataFrame:
    """The anomalies of a target's report that no baseline report has; both are tables of anomalies."""
    return fresh(target, index_of(known_lines(baselines), tokens), tokens)


def report_errors(target: DataFrame, baseline: DataFrame, config: TargetConfig | None = None) -> DataFrame:
    """The errors of target lines that are not known from the errors of baseline lines (of the very same index)."""
    return fresh(errors_report(target, config), train_errors(baseline, config))

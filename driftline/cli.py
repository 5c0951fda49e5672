"""Command line: ``python -m driftline.cli diff BASELINE TARGET`` and the like; see ``--help``."""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import config, paths, tokenizer
from .operators import known, reports, similarity
from .sinks import store
from .sources import archives, inputs, web


def _config(args: argparse.Namespace) -> config.TargetConfig:
    return config.parse(Path(args.config).read_text(), args.config).target(args.job) if args.config else config.TargetConfig()


def _lines(spark: SparkSession, where: str, setting: config.TargetConfig):
    read = archives.read_lines(spark, inputs.of_input(where).where, setting)
    return archives.log_lines(read), archives.read_errors(read)


def diff(spark: SparkSession, args: argparse.Namespace) -> None:
    """Report what is new in TARGET against the baselines, or against a saved model."""
    setting = _config(args)
    target, unread = _lines(spark, args.target, setting)
    if args.model and Path(args.model).exists():
        model = store.load_model(spark, args.model)
    else:
        every = [_lines(spark, b, setting)[0] for b in [*(args.baselines or [inputs.baselines(inputs.of_input(args.target))[0].where]), *setting.extra_baselines]]
        model = reports.merge(*(reports.train(x, setting) for x in every)) if len(every) > 1 else reports.train(every[0], setting)
        if args.model:
            store.save_model(model, args.model, int(time.time() * 1000))
    out = reports.report(target, model, setting, read_errors=unread)
    if args.report:
        store.save_report(out, args.report, "json" if args.json else "parquet")
    else:
        for row in store.as_text(out.anomalies).orderBy("index_name", "source", "seq").toLocalIterator():
            print(row.source, row.text, sep="\n")


def errors(spark: SparkSession, args: argparse.Namespace) -> None:
    """Errors of TARGET; with baselines, only those that they do not have."""
    setting = _config(args)
    target = _lines(spark, args.target, setting)[0]
    found = known.errors_report(target, setting)
    for b in args.baselines or []:
        found = known.fresh(found, known.train_errors(_lines(spark, b, setting)[0], setting))
    for row in found.orderBy("source", "pos").toLocalIterator():
        print(row.source, row.pos, row.line)


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    setting = _config(args)
    store.save_model(reports.merge(*(reports.train(_lines(spark, b, setting)[0], setting) for b in args.baselines)), args.model, int(time.time() * 1000))


def check_model(spark: SparkSession, args: argparse.Namespace) -> None:
    made = store.check_model(spark, args.model)
    if args.max_age is not None and time.time() * 1000 - made > args.max_age * 86_400_000:
        raise SystemExit(f"{args.model}: older than {args.max_age} days")
    store.load_model(spark, args.model).meta.orderBy("index_name").show(1000, truncate=False)


def filter_report(spark: SparkSession, args: argparse.Namespace) -> None:
    target = store.load_report(spark, args.target).anomalies
    for b in args.baselines:
        target = known.filter_reports(store.load_report(spark, b).anomalies, target)
    target.orderBy("index_name", "source", "seq").write.mode("overwrite").parquet(args.report)


def shared(spark: SparkSession, args: argparse.Namespace) -> None:
    """What saved reports have in common."""
    held = None
    for k, path in enumerate(args.reports):
        one = tokenizer.with_tokens(store.load_report(spark, path).anomalies).select(F.lit(k).alias("target"), "index_name", "source", "pos", "tokens", "line")
        held = one if held is None else held.unionByName(one)
    found = similarity.shared(held)
    similarity.percents(found).orderBy("t1", "t2").show(1000, truncate=False)
    similarity.top(found).show(100, truncate=False)


def http_ls(spark: SparkSession, args: argparse.Namespace) -> None:
    for url in web.crawl(args.url, web.http_fetch()):
        print(url)


def groups(spark: SparkSession, args: argparse.Namespace) -> None:
    archives.groups(_lines(spark, args.target, _config(args))[0]).orderBy("index_name").show(1000, truncate=False)


def debug(spark: SparkSession, args: argparse.Namespace) -> None:
    print(tokenizer.tokenize(args.text) if args.what == "tokenizer" else spark.range(1).select(paths.index_name(F.lit(args.text))).first()[0])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = argparse.ArgumentParser(prog="driftline")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *names: str, **options):
        p = commands.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        for n in names:
            p.add_argument(n, **options.get(n, {}))
        p.add_argument("--config")
        p.add_argument("--job")
        return p

    for name, run in (("diff", diff), ("errors", errors)):
        p = command(name, run, "target")
        p.add_argument("--baselines", nargs="+")
        if run is diff:
            p.add_argument("--model")
            p.add_argument("--report")
            p.add_argument("--json", action="store_true")
    command("train", train, "model", "baselines", baselines={"nargs": "+"})
    command("check-model", check_model, "model").add_argument("--max-age", type=int)
    command("filter-report", filter_report, "report", "target", "baselines", baselines={"nargs": "+"})
    command("similarity", shared, "reports", reports={"nargs": "+"})
    command("http-ls", http_ls, "url")
    command("debug-groups", groups, "target")
    command("debug", debug, "what", "text", what={"choices": ["tokenizer", "indexname"]})
    args = top.parse_args(argv)
    args.run(spark or SparkSession.builder.appName("driftline").getOrCreate(), args)


if __name__ == "__main__":
    main()

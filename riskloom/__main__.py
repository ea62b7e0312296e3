"""Command line: ``spark-submit`` or ``python -m riskloom <command> --help``."""

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators import reporting
from riskloom.operators.cleaning import require_rows
from riskloom.operators.models import scorer_for
from riskloom.operators.ordering import thin
from riskloom.plans import training
from riskloom.plans.recipes import PLAIN_RECIPES, RECIPES, scenario
from riskloom.plans.scoring import score_batch
from riskloom.plans.serving import load_local
from riskloom.schema import FEATURES
from riskloom.sources import files
from riskloom.sources.artifacts import load_artifacts, read_report, status


def _input(spark: SparkSession, args) -> DataFrame:
    good, bad = files.read_transactions(spark, args.data, args.format, args.strict, positions=True)
    if args.quarantine:
        bad.write.mode("overwrite").json(args.quarantine)
    return require_rows(good)


def _train(spark: SparkSession, args) -> None:
    raw = _input(spark, args)
    trained = training.train(raw, args.out, ratio=args.ratio, fit_scope=args.fit_scope)
    trained.metrics.show(truncate=False)
    print(f"best model: {trained.best}")


def _score(spark: SparkSession, args) -> None:
    artifacts = load_artifacts(spark, args.artifacts)
    medians = artifacts.medians if args.impute == "fitted" else None
    predictions, rejected = score_batch(
        _input(spark, args), scorer_for(artifacts.model), artifacts.scaler, medians
    )
    files.write_scored(predictions, *args.out, mode="overwrite")
    if args.rejected:
        rejected.write.mode("overwrite").json(args.rejected)


def _one(spark: SparkSession, args) -> None:
    print(json.dumps(load_local(spark, args.artifacts)(json.loads(args.transaction))))


def _report(spark: SparkSession, args) -> None:
    scored = files.read_scored(spark, args.scored)
    totals = reporting.summary(scored)
    tables = {
        "summary": totals,
        "kpis": reporting.kpis(totals),
        "labels": reporting.label_counts(scored),
        "histogram": reporting.histogram(scored),
        "top": reporting.with_badge(reporting.top_risk(scored)),
        "first": reporting.first_rows(scored, args.label),
        "series": thin(scored.select("row", "risk_score"), "row"),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{args.out}/{name}")


def _status(spark: SparkSession, args) -> None:
    status(spark, args.artifacts).show(truncate=False)
    read_report(spark, f"{args.artifacts}/report").show(truncate=False)


def _mix(spark: SparkSession, args) -> None:
    rows = _input(spark, args)
    names = args.names or list(PLAIN_RECIPES if args.plain else RECIPES)
    for name in names:
        mixed = scenario(rows, name, args.seed, args.plain).orderBy("row").select(FEATURES)
        files.write_csv(mixed, *[f"{out}/{name}" for out in args.out], mode="overwrite")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="riskloom", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(name, run, text, reads_rows=False):
        sub = commands.add_parser(name, help=text)
        sub.set_defaults(run=run)
        if reads_rows:
            sub.add_argument("--data", required=True)
            sub.add_argument("--format", default="csv")
            sub.add_argument("--strict", action="store_true", help="stop at the first bad row")
            sub.add_argument("--quarantine", help="folder for rows that cannot be read")
        return sub

    train = command("train", _train, "train, compare and save models", True)
    train.add_argument("--out", required=True)
    train.add_argument("--ratio", type=float, default=0.1, help="minority : majority after rebalancing")
    train.add_argument("--fit-scope", choices=["train", "all"], default="train")
    score = command("score", _score, "score a batch", True)
    score.add_argument("--artifacts", required=True)
    score.add_argument("--out", required=True, nargs="+")
    score.add_argument("--rejected", help="folder for rows that cannot be scored")
    score.add_argument("--impute", choices=["batch", "fitted"], default="batch")
    one = command("score-one", _one, "score one JSON transaction")
    one.add_argument("--artifacts", required=True)
    one.add_argument("transaction")
    report = command("report", _report, "tables over an exported score file")
    report.add_argument("--scored", required=True)
    report.add_argument("--out", required=True)
    report.add_argument("--label", choices=["all", "fraud", "legit"], default="all")
    state = command("status", _status, "what an artifact folder holds")
    state.add_argument("--artifacts", required=True)
    mix = command("mix", _mix, "draw scenario files from labelled rows", True)
    mix.add_argument("--out", required=True, nargs="+")
    mix.add_argument("--plain", action="store_true", help="plain additive noise only")
    mix.add_argument("--seed", type=int, default=42)
    mix.add_argument("names", nargs="*")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("riskloom").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()

"""Train, compare and save the candidate models."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskloom.operators.cleaning import align, dedup, drop_missing, require_columns, require_rows
from riskloom.operators.evaluation import champion, model_metrics, report
from riskloom.operators.medians import fit_medians
from riskloom.operators.models import as_pipeline, assembler, candidates, compare, scorer_for
from riskloom.operators.ordering import with_row
from riskloom.operators.sampling import stratified_split
from riskloom.operators.scaling import Scaler, apply_scaler, fit_scaler
from riskloom.operators.smote import smote
from riskloom.schema import FEATURES, KEY, LABEL
from riskloom.sources.artifacts import Artifacts, save_artifacts, write_report
from riskloom.storage import materialise


@dataclass
class Prepared:
    """``train`` is scaled and rebalanced, ``test`` is scaled only."""

    train: DataFrame
    test: DataFrame
    scaler: Scaler
    medians: dict[str, float]


def clean(raw: DataFrame) -> DataFrame:
    """Aligned, distinct, complete rows, written once; rows without a number as key get one."""
    rows = drop_missing(align(require_columns(raw)))
    if KEY in rows.columns and not isinstance(rows.schema[KEY].dataType, T.LongType):
        rows = rows.drop(KEY)
    kept = dedup(rows).drop("copies")
    if KEY not in kept.columns:
        kept = with_row(kept, *FEATURES, LABEL, row=KEY)
    return require_rows(materialise(kept.select(KEY, LABEL, *FEATURES), "clean"))


def prepare(
    raw: DataFrame, ratio: float = 0.1, seed: int = 42, test_fraction: float = 0.2, fit_scope: str = "train"
) -> Prepared:
    """Clean, split, scale, rebalance.

    The scaler sees the training rows only; ``fit_scope="all"`` lets it see every row. With
    ``ratio`` 0 the classes stay as they are.
    """
    rows = clean(raw)
    train, test = stratified_split(rows, test_fraction, seed)
    scaler = fit_scaler(train if fit_scope == "train" else rows)
    medians = fit_medians(train)
    scaled = apply_scaler(train, scaler)
    balanced = smote(scaled, ratio, seed=seed) if ratio else scaled
    return Prepared(materialise(balanced, "train"), apply_scaler(test, scaler), scaler, medians)


@dataclass
class Trained:
    models: dict
    predictions: DataFrame
    metrics: DataFrame
    best: str
    artifacts: Artifacts
    report: DataFrame


def fit_all(prepared: Prepared, fits: dict | None = None) -> Trained:
    """Fit every candidate, score the test rows with each, pick the champion."""
    fits = fits or candidates()
    vectors = materialise(
        assembler().transform(prepared.train).select(KEY, LABEL, "features"), "vectors"
    )
    models = {name: fit(vectors) for name, fit in fits.items()}
    scorers = {name: scorer_for(as_pipeline(model)) for name, model in models.items()}
    predictions = materialise(compare(prepared.test, scorers), "predictions")
    names = list(fits)
    metrics = materialise(model_metrics(predictions), "metrics")
    best = champion(metrics, names).first()["model"]
    artifacts = Artifacts(as_pipeline(models[best]), prepared.scaler, prepared.medians)
    return Trained(
        models, predictions, metrics, best, artifacts, report(metrics, names, FEATURES)
    )


def train(raw: DataFrame, out: str, fits: dict | None = None, **options) -> Trained:
    """The whole of it: prepare, fit, save champion, scaler, medians and report under ``out``."""
    trained = fit_all(prepare(raw, **options), fits)
    found = materialise(trained.report, "report")
    save_artifacts(raw.sparkSession, out, trained.artifacts, found)
    write_report(found, out)
    return trained

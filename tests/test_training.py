import pytest
from pyspark.sql import functions as F

from riskloom.operators.models import (
    BOOSTED,
    FOREST,
    LOGISTIC,
    FixedLogit,
    ModelScorer,
    as_pipeline,
    candidates,
    fit_logistic,
    importance,
    scorer_for,
)
from riskloom.plans import training
from riskloom.plans.scoring import score_batch
from riskloom.schema import FEATURES, KEY
from riskloom.sources.artifacts import load_artifacts, read_report, status
from riskloom.storage import new_path
from riskloom.streaming import live


@pytest.fixture(scope="module")
def trained(spark, learnable):
    out = new_path(spark, "test-artifacts")
    fits = candidates(trees=20, rounds=10)
    return out, training.train(learnable, out, fits)


def test_preparation(spark, separable):
    dirty = separable.unionByName(separable.filter("tx_id < 40")).withColumn(
        "Amount", F.when(F.col(KEY) == 383, None).otherwise(F.col("Amount"))
    )
    prepared = training.prepare(dirty.drop(KEY))
    n_test = prepared.test.count()
    assert n_test == 77  # 383 rows left
    assert prepared.train.filter(f"{KEY} > 0").count() == 383 - n_test
    n = {r["Class"]: r["count"] for r in prepared.train.groupBy("Class").count().collect()}
    assert n[1] == int(0.1 * n[0])
    assert prepared.test.filter(f"{KEY} < 0").count() == 0
    everything = training.prepare(separable, fit_scope="all").scaler
    assert everything.means["Time"] == pytest.approx(separable.agg(F.avg("Time")).first()[0])


def test_all_models_learn(trained):
    _, result = trained
    metrics = {r["model"]: r for r in result.metrics.collect()}
    assert set(metrics) == {LOGISTIC, FOREST, BOOSTED}
    assert min(metrics[LOGISTIC]["roc_auc"], metrics[FOREST]["roc_auc"]) > 0.95
    assert metrics[BOOSTED]["roc_auc"] > 0.85  # after 10 of its 300 rounds
    assert result.best == max(metrics, key=lambda m: (metrics[m]["roc_auc"], m == LOGISTIC))


def test_artifacts_and_report(spark, trained):
    out, result = trained
    row = status(spark, out).first()
    assert (row["model_loaded"], row["model_name"], row["n_features"]) == (True, result.best, 30)
    report = read_report(spark, f"{out}/report").first()
    assert report["feature_names"] == FEATURES
    assert [m["model"] for m in report["all_metrics"]] == [LOGISTIC, FOREST, BOOSTED]


def test_importance(spark, trained):
    _, result = trained
    rows = importance(result.models[FOREST]).collect()
    values = [r["importance"] for r in rows]
    assert len(rows) == 15 and values == sorted(values, reverse=True)
    assert importance(result.models[LOGISTIC]) is None


def test_logistic_expression_equals_the_model(spark, learnable, trained):
    _, result = trained
    pipeline = as_pipeline(result.models[LOGISTIC])
    expression = scorer_for(pipeline)
    assert isinstance(expression, FixedLogit)
    assert isinstance(scorer_for(as_pipeline(result.models[FOREST])), ModelScorer)
    rows = learnable.withColumn("Time", F.col("Time") / 1e5)
    both = expression(rows).select(KEY, "p", "prediction").join(
        ModelScorer(pipeline)(rows).select(KEY, F.col("p").alias("q"), F.col("prediction").alias("r")), KEY
    )
    worst = both.agg(F.max(F.abs(F.col("p") - F.col("q"))), F.count_if(F.col("prediction") != F.col("r")))
    assert worst.first()[0] < 1e-12 and worst.first()[1] == 0


def test_logistic_matches_the_penalised_optimum(spark):
    """Gradient of the summed weighted loss plus w/C is zero at the fit, with C = 1."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + rng.normal(size=200) > 1).astype(int)
    rows = [(int(c), Vectors.dense(v)) for c, v in zip(y, x)]
    model = fit_logistic(spark.createDataFrame(rows, ["Class", "features"]).withColumn("Class", F.col("Class").cast("int")))
    w, b = model.coefficients.toArray(), model.intercept
    weight = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(x @ w + b)))
    gradient = x.T @ (weight * (p - y)) + w
    assert np.abs(gradient).max() < 0.05
    assert abs((weight * (p - y)).sum()) < 0.05


def test_stream_equals_batch(spark, separable, trained):
    out, _ = trained
    loaded = load_artifacts(spark, out)
    incoming = new_path(spark, "test-incoming")
    gaps = separable.withColumn("V3", F.when(F.col(KEY) % 10 != 3, F.col("V3")))
    gaps.drop("Class").repartition(3).write.parquet(incoming)
    scorer = ModelScorer(loaded.model)
    batch, _ = score_batch(spark.read.parquet(incoming), scorer, loaded.scaler, loaded.medians)
    from riskloom.sources.files import stream_transactions

    stream = live.score_stream(
        stream_transactions(spark, incoming, maxFilesPerTrigger=1), scorer, loaded.scaler, loaded.medians
    )
    sink = new_path(spark, "test-live")
    live.to_parquet(stream.select(KEY, "label", "fraud_probability"), sink).awaitTermination()
    key = lambda df: sorted(map(tuple, df.select(KEY, "label", "fraud_probability").collect()))
    assert key(spark.read.parquet(sink)) == key(batch)

    live.totals_to_view(live.running_totals(stream), "test_totals").awaitTermination()
    row = spark.table("test_totals").first()
    assert row["total_rows"] == 384
    assert row["fraud_count"] == batch.filter("label = 'FRAUD'").count()


def test_rejected_rows_of_a_stream(spark):
    incoming = new_path(spark, "test-rejects")
    spark.createDataFrame([(1, 2.0), (2, -1.0)], f"{KEY} long, Amount double").write.parquet(incoming)
    stream = spark.readStream.schema(f"{KEY} long, Amount double").parquet(incoming)
    sink = new_path(spark, "test-rejected")
    live.to_parquet(live.rejected_stream(stream, {}).select(KEY, "reject_reason"), sink).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(sink).collect()] == [(2, "negative amount")]


def test_registered_boosting_runs_all_rounds(spark, sf_dir, monkeypatch):
    from riskloom.operators import models
    from riskloom.plans.registry import QUERIES

    class Seen(Exception):
        pass

    def fit(frame, settings):
        raise Seen(settings.rounds)

    monkeypatch.setattr(models, "fit_trees", fit)
    for name in ("train_gbt", "train_and_save"):
        with pytest.raises(Seen, match="^300$"):
            QUERIES[name](spark, sf_dir)

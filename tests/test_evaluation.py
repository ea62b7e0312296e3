import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from riskloom.functions.risk import hard_class
from riskloom.operators.evaluation import (
    binary_metrics,
    champion,
    confusion,
    model_metrics,
    report,
    roc_auc,
    roc_points,
)
from riskloom.schema import FEATURES


def scored(spark, pairs, model="m"):
    rows = [(model, int(c), float(p)) for c, p in pairs]
    df = spark.createDataFrame(rows, "model string, Class int, p double")
    return df.withColumn("prediction", hard_class(F.col("p")))


def random_pairs(n=2_000, digits=2, seed=0):
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 2, n)
    return list(zip(labels, np.round(np.clip(labels * 0.2 + rng.random(n) * 0.8, 0, 1), digits)))


def pairwise_auc(pairs):
    pos = np.array([p for c, p in pairs if c])
    neg = np.array([p for c, p in pairs if not c])
    wins = (pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_auc_equals_pairs_and_spark(spark, digits):
    pairs = random_pairs(digits=digits)
    df = scored(spark, pairs).repartition(5)
    auc = roc_auc(df).first()["roc_auc"]
    assert abs(auc - pairwise_auc(pairs)) < 1e-12
    spark_auc = BinaryClassificationEvaluator(
        rawPredictionCol="p", labelCol="Class", numBins=0
    ).evaluate(df)
    assert abs(auc - spark_auc) < 1e-9


def test_auc_of_one_class_is_unknown(spark):
    assert roc_auc(scored(spark, [(1, 0.2), (1, 0.9)])).first()["roc_auc"] is None


def test_unknown_scores_do_not_count(spark):
    df = scored(spark, [(0, 0.1), (1, 0.9), (0, float("nan")), (1, float("nan"))])
    assert roc_auc(df).first()["roc_auc"] == 1.0


def test_constant_score_is_chance(spark):
    assert roc_auc(scored(spark, [(0, 0.5), (1, 0.5), (1, 0.5)])).first()["roc_auc"] == 0.5


def test_metrics_are_zero_safe(spark):
    df = scored(spark, [(0, 0.1), (0, 0.2), (1, 0.3)])
    row = binary_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    assert round(row["accuracy"], 4) == 0.6667
    cells = {(r["actual"], r["predicted"]): r["n"] for r in confusion(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_one_half_is_class_zero(spark):
    assert scored(spark, [(1, 0.5)]).first()["prediction"] == 0


@pytest.mark.parametrize(
    ("tp", "fp", "fn", "wanted"),
    [
        (94, 405, 4, (0.9928, 0.1884, 0.9592, 0.3149)),
        (92, 0, 6, (0.9999, 1.0, 0.9388, 0.9684)),
        (93, 3, 5, (0.9999, 0.9688, 0.949, 0.9588)),
    ],
)
def test_published_figures_follow_from_their_cells(spark, tp, fp, fn, wanted):
    cells = [(1, 0.9, tp), (0, 0.9, fp), (1, 0.1, fn), (0, 0.1, 56_962 - tp - fp - fn)]
    df = spark.createDataFrame(cells, "Class int, p double, n int").withColumn("prediction", hard_class(F.col("p")))
    df = df.withColumn("copy", F.explode(F.expr("sequence(1, greatest(n, 1))"))).filter("n > 0")
    row = binary_metrics(df).first()
    got = tuple(round(row[c], 4) for c in ("accuracy", "precision", "recall", "f1"))
    assert got == wanted


def curve(pairs, drop):
    """Points of the curve by sorting, straight runs dropped on demand."""
    pairs = sorted(pairs, key=lambda x: -x[1])
    tps, fps, points = 0, 0, []
    for i, (c, p) in enumerate(pairs):
        tps, fps = tps + c, fps + 1 - c
        if i + 1 == len(pairs) or pairs[i + 1][1] != p:
            points.append((p, fps, tps))
    if drop and len(points) > 2:
        f, t = [x[1] for x in points], [x[2] for x in points]
        bent = [True, *[bool(a or b) for a, b in zip(np.diff(f, 2), np.diff(t, 2))], True]
        points = [x for x, keep in zip(points, bent) if keep]
    return [(None, 0.0, 0.0)] + [(p, a / fps, b / tps) for p, a, b in points]


@pytest.mark.parametrize("drop", [True, False])
@pytest.mark.parametrize("digits", [1, 3])
def test_roc_points(spark, drop, digits):
    pairs = random_pairs(400, digits)
    got = roc_points(scored(spark, pairs).repartition(4), drop).collect()
    got = sorted(((r["threshold"], r["fpr"], r["tpr"]) for r in got), key=lambda x: -(x[0] if x[0] is not None else 9))
    assert [(p, round(a, 12), round(b, 12)) for p, a, b in got] == [
        (p, round(a, 12), round(b, 12)) for p, a, b in curve(pairs, drop)
    ]


def test_champion_ties_go_to_the_first_listed(spark):
    rows = [("b", 0.9, 0.90004), ("a", 0.8, 0.90001), ("c", 0.7, None)]
    df = spark.createDataFrame(rows, "model string, accuracy double, roc_auc double")
    assert champion(df, ["a", "b", "c"]).first()["model"] == "a"
    assert champion(df, ["c", "b", "a"]).first()["model"] == "b"


def test_report_lists_models_in_order(spark):
    both = scored(spark, random_pairs(100), "z").unionByName(scored(spark, random_pairs(100, seed=1), "y"))
    row = report(model_metrics(both), ["z", "y"], FEATURES).first()
    assert [m["model"] for m in row["all_metrics"]] == ["z", "y"]
    assert row["feature_names"] == FEATURES
    best = max(row["all_metrics"], key=lambda m: m["roc_auc"])
    assert (row["best_model"], row["best_roc_auc"]) == (best["model"], best["roc_auc"])

import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions.risk import badge, confidence_of, label_of, risk_score, slug
from riskloom.operators import reporting
from riskloom.operators.models import FixedLogit
from riskloom.operators.scaling import Scaler
from riskloom.plans.scoring import add_risk, score_batch, score_single
from riskloom.schema import EXPORT

UNIT = Scaler({"Amount": 0.0, "Time": 0.0}, {"Amount": 1.0, "Time": 1.0})
LOGIT = FixedLogit(-1.0, {"Amount": 0.5, "V1": 1.0})


@pytest.mark.parametrize(
    ("p", "label", "confidence", "tier"),
    [
        (0.0, "LEGIT", "SAFE", "safe"),
        (0.2999999, "LEGIT", "SAFE", "safe"),
        (0.30, "LEGIT", "LOW RISK", "safe"),
        (0.4999999, "LEGIT", "LOW RISK", "safe"),
        (0.50, "FRAUD", "MEDIUM", "medium"),
        (0.7999999, "FRAUD", "MEDIUM", "medium"),
        (0.80, "FRAUD", "HIGH", "fraud"),
        (1.0, "FRAUD", "HIGH", "fraud"),
        (math.nan, None, None, "safe"),
        (None, None, None, "safe"),
    ],
)
def test_bands(spark, p, label, confidence, tier):
    df = spark.createDataFrame([(p,)], "p double").select(
        label_of(F.col("p")).alias("l"), confidence_of(F.col("p")).alias("c")
    )
    row = df.withColumn("b", badge(F.col("l"), F.col("c"))).first()
    assert (row["l"], row["c"], row["b"]) == (label, confidence, tier)


def test_bands_are_a_parameter(spark):
    df = spark.createDataFrame([(0.6,)], "p double")
    row = add_risk(df, [(0.7, "STOP", "SURE")], ("GO", "FINE")).first()
    assert (row["label"], row["confidence"]) == ("GO", "FINE")


def test_slug_and_score(spark):
    row = spark.range(1).select(slug(F.lit("Random Forest")).alias("s"), risk_score(F.lit(0.98765)).alias("r")).first()
    assert (row["s"], row["r"]) == ("random_forest", 98.77)


def scored(spark, scores, labels=None):
    labels = labels or ["FRAUD" if s >= 50 else "LEGIT" for s in scores]
    rows = [(i + 1, 1.0, float(s), s / 100, lab, "X") for i, (s, lab) in enumerate(zip(scores, labels))]
    names = "row long, amount double, risk_score double, fraud_probability double, label string, confidence string"
    return spark.createDataFrame(rows, names)


def test_summary_of_nothing(spark):
    row = reporting.summary(scored(spark, [1]).limit(0)).first()
    assert tuple(row) == (0, 0, 0, 0.0)


def test_summary_equals_histogram(spark):
    df = scored(spark, [0, 9.99, 10, 20, 29.99, 30, 49.99, 50, 69.99, 70, 89.99, 90, 100])
    counts = [r["n"] for r in sorted(reporting.histogram(df).collect(), key=lambda r: r["low"])]
    assert counts == [2, 1, 2, 2, 2, 2, 2]
    row = reporting.summary(df).first()
    assert row["total_rows"] == sum(counts) == 13
    assert (row["fraud_count"], row["legit_count"], row["fraud_rate"]) == (6, 7, 46.1538)
    shown = reporting.kpis(reporting.summary(df)).first()
    assert (shown["total"], shown["rate"]) == ("13", "46.15%")
    assert shown["subtitle"] == "Showing 13 transactions · 6 flagged"


def test_both_labels_are_listed(spark):
    got = {r["label"]: r["n"] for r in reporting.label_counts(scored(spark, [1, 2])).collect()}
    assert got == {"FRAUD": 0, "LEGIT": 2}


def test_top_breaks_ties_by_row(spark):
    df = scored(spark, [50] * 15 + [60] * 3 + [50] * 15)
    top = sorted(reporting.top_risk(df.repartition(5)).collect(), key=lambda r: r["rank"])
    assert [r["row"] for r in top] == [16, 17, 18, *range(1, 16), 19, 20]


def test_first_rows_after_filter(spark):
    df = scored(spark, [90 if i % 2 else 10 for i in range(1_300)])
    rows = reporting.first_rows(df, "fraud").collect()
    assert len(rows) == 500 and {r["matching"] for r in rows} == {650}
    assert max(r["row"] for r in rows) == 1_000
    assert reporting.first_rows(df, "all", 2_000).first()["shown"] == 1_300


def test_score_batch_fills_rejects_and_numbers(spark):
    rows = [(30, 1.0, 2.0), (10, None, 4.0), (20, 3.0, -1.0), (40, 5.0, None)]
    df = spark.createDataFrame(rows, "tx_id long, V1 double, Amount double").withColumn("Class", F.lit(1))
    got, rejected = score_batch(df, LOGIT, UNIT)
    assert got.columns == ["tx_id", *EXPORT]
    assert [r["tx_id"] for r in rejected.collect()] == [20]
    assert [(r["row"], r["reject_reason"]) for r in rejected.collect()] == [(2, "negative amount")]
    by_row = {r["row"]: r for r in got.collect()}
    assert [by_row[i]["tx_id"] for i in (1, 3, 4)] == [10, 30, 40]
    # V1 of row 1 is the batch median of 1 and 5, Amount of row 3 that of 2 and 4
    p = [1 / (1 + math.exp(-(-1 + 0.5 * a + v))) for a, v in ((4, 3), (2, 1), (3, 5))]
    assert [by_row[i]["fraud_probability"] for i in (1, 3, 4)] == [round(x, 4) for x in p]
    assert by_row[4]["amount"] is None and by_row[3]["amount"] == 2.0


def test_score_batch_with_fitted_medians(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "tx_id long, V1 double, Amount double")
    got = score_batch(df, LOGIT, UNIT, {"V1": -1.0})[0].first()
    assert got["fraud_probability"] == round(1 / (1 + math.exp(1.0)), 4)


def test_a_feature_without_any_value_rejects_its_rows(spark):
    rows = [(1, None, 2.0), (2, math.nan, 3.0)]
    df = spark.createDataFrame(rows, "tx_id long, V1 double, Amount double")
    got, rejected = score_batch(df, LOGIT, UNIT)
    assert got.count() == 0
    assert {r["reject_reason"] for r in rejected.collect()} == {"no value for V1"}


def test_infinite_values_are_rejected(spark):
    df = spark.createDataFrame([(1, math.inf, 2.0), (2, 1.0, 3.0)], "tx_id long, V1 double, Amount double")
    got, rejected = score_batch(df, LOGIT, UNIT)
    assert [r["row"] for r in got.collect()] == [2]
    assert rejected.first()["reject_reason"] == "no value for V1"


def test_score_single(spark):
    got = score_single(spark, {"Amount": 4.0, "V1": 2.0}, LOGIT, UNIT)
    assert got == {"fraud_probability": 0.9526, "risk_score": 95.26, "label": "FRAUD", "confidence": "HIGH"}
    for bad in ({"Amount": -1.0}, {"V1": 2.0}):
        with pytest.raises(ValueError, match="Amount"):
            score_single(spark, bad, LOGIT, UNIT)

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.smote import smote, smote_count, synthesise
from riskloom.schema import FEATURES


def test_count_and_errors():
    assert smote_count(1000, 20, 0.1) == 80
    with pytest.raises(ValueError, match="already"):
        smote_count(1000, 100, 0.1)
    with pytest.raises(ValueError, match="more than 5"):
        smote_count(1000, 5, 0.1)


def test_new_rows_lie_between_base_and_neighbour(spark, separable):
    minority = separable.filter("Class = 1")
    points = {r["tx_id"]: np.array([r[c] for c in FEATURES]) for r in minority.collect()}
    new = synthesise(minority, 60, 24).collect()
    assert sorted(r["tx_id"] for r in new) == list(range(-60, 0))
    for r in new:
        assert 0 <= r["step"] < 1 and r["base_id"] != r["nn_id"]
        a, b = points[r["base_id"]], points[r["nn_id"]]
        assert np.allclose([r[c] for c in FEATURES], a + r["step"] * (b - a))


def test_smote_adds_minority_rows_only(spark, separable):
    out = smote(separable, 0.1)
    counts = {r["Class"]: r["count"] for r in out.groupBy("Class").count().collect()}
    assert counts == {0: 360, 1: 36}
    assert out.filter("tx_id >= 0").count() == 384
    again = smote(separable.repartition(6), 0.1)
    key = lambda df: sorted(map(tuple, df.select("tx_id", *[F.round(c, 9) for c in FEATURES]).collect()))
    assert key(out) == key(again)


def test_one_class_is_refused(spark, separable):
    with pytest.raises(ValueError, match="two classes"):
        smote(separable.filter("Class = 0"))

import numpy as np
import pytest

from riskloom.operators.medians import (
    approximate_medians,
    exact_medians,
    fit_medians,
    impute,
    impute_from_batch,
)


def test_even_count_is_the_mean_of_the_middle(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "a double")
    assert exact_medians(df, ["a"]) == {"a": 3.0}


def test_all_missing_column_has_no_median(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "a double, b double")
    assert exact_medians(df, ["a", "b"]) == {"b": 1.5}
    assert [r["a"] for r in impute_from_batch(df, ["a", "b"]).collect()] == [None, None]


@pytest.mark.parametrize("small", [1, 20, 100_000])
def test_selection_equals_sorting(spark, small):
    """Also with hot values: a third of one column is a single value next to the middle."""
    rng = np.random.default_rng(3)
    n = 3_000
    columns = {
        "normal": rng.normal(size=n),
        "skewed": np.exp(rng.normal(size=n) * 3),
        "hot": np.where(rng.random(n) < 0.34, 0.25, rng.normal(size=n)),
        "hot_at_edge": np.concatenate([np.full(n // 2, -1.0), rng.random(n - n // 2)]),
        "one_value": np.full(n, 7.0),
        "two_values": np.repeat([0.0, 1.0], n // 2),
        "whole": rng.integers(0, 5, n).astype(float),
    }
    names = list(columns)
    rows = [tuple(map(float, r)) for r in np.column_stack(list(columns.values()))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5).cache()
    got = exact_medians(df, names, small=small)
    assert got == {c: float(np.median(v)) for c, v in columns.items()}


def test_approximate_is_close(spark):
    df = spark.range(10_001).selectExpr("cast(id as double) as a")
    assert abs(approximate_medians(df, ["a"])["a"] - 5_000) <= 2
    assert fit_medians(df, ["a"]) == {"a": 5_000.0}


def test_impute_leaves_known_values(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    assert [tuple(r) for r in impute(df, {"a": 9.0}).collect()] == [(1.0, None), (9.0, 2.0)]

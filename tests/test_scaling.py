import pytest

from riskloom.operators.scaling import Scaler, apply_scaler, fit_scaler


def test_population_std(spark):
    df = spark.createDataFrame([(float(x), 5.0) for x in (1, 2, 4, 10)], "Amount double, Time double")
    scaler = fit_scaler(df)
    assert scaler.means["Amount"] == 4.25
    assert round(scaler.stds["Amount"], 4) == 3.4911
    assert scaler.stds["Time"] == 1.0  # constant column


def test_apply_needs_a_scaler_and_both_columns(spark):
    df = spark.createDataFrame([(3.0,)], "Amount double")
    with pytest.raises(ValueError, match="fitted scaler"):
        apply_scaler(df, None)
    scaler = Scaler({"Amount": 1.0, "Time": 0.0}, {"Amount": 2.0, "Time": 1.0})
    assert apply_scaler(df, scaler).first()["Amount"] == 3.0
    both = spark.createDataFrame([(3.0, 1.0)], "Amount double, Time double")
    assert tuple(apply_scaler(both, scaler).first()) == (1.0, 1.0)


def test_missing_values_do_not_count(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (float("nan"), 1.0), (3.0, 1.0)], "Amount double, Time double")
    assert fit_scaler(df).means["Amount"] == 2.0


def test_nothing_to_fit(spark):
    with pytest.raises(ValueError, match="Amount"):
        fit_scaler(spark.createDataFrame([], "Amount double, Time double"))


def test_frame_roundtrip(spark):
    scaler = Scaler({"Amount": 1.5}, {"Amount": 2.5})
    assert Scaler.from_frame(scaler.to_frame(spark)) == scaler

import math

import pytest

from riskloom.operators.audit import load_audit
from riskloom.operators.cleaning import (
    align,
    dedup,
    drop_label,
    drop_missing,
    quality_gates,
    require_columns,
    require_rows,
    validate,
)
from riskloom.schema import FEATURES


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1.0,)], "Amount double")
    with pytest.raises(ValueError, match=r"\['Class', 'Time'\]"):
        require_columns(df)


def test_empty_input_is_refused(spark):
    with pytest.raises(ValueError, match="empty"):
        require_rows(spark.createDataFrame([], "a int"))


def test_dedup_keeps_smallest_key_and_counts_copies(spark):
    nan = float("nan")
    rows = [(3, 1.0, None), (1, 1.0, None), (2, nan, 2.0), (5, nan, 2.0), (4, 0.0, 1.0), (6, -0.0, 1.0)]
    df = spark.createDataFrame(rows, "tx_id long, a double, b double")
    got = {r["tx_id"]: r["copies"] for r in dedup(df).collect()}
    assert got == {1: 2, 2: 2, 4: 2}


def test_drop_missing_takes_null_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "tx_id long, a double")
    assert [r["tx_id"] for r in drop_missing(df).collect()] == [1]


def test_align_adds_drops_orders_and_parses(spark):
    df = spark.createDataFrame(
        [(7, "1.5", "x", "NA"), (8, "abc", "y", "")], "tx_id long, Amount string, other string, V3 string"
    )
    out = align(df)
    assert out.columns == ["tx_id", *FEATURES]
    first, second = out.orderBy("tx_id").collect()
    assert (first["Amount"], first["V3"], first["Time"], first["V28"]) == (1.5, None, 0.0, 0.0)
    assert second["Amount"] is None


def test_drop_label_without_label(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert drop_label(df).columns == ["a"]


def test_validate_is_a_partition_of_the_input(spark):
    rows = [(1, 5.0), (2, -0.01), (3, 0.0), (4, None)]
    df = spark.createDataFrame(rows, "tx_id long, Amount double")
    valid, rejected = validate(df)
    assert sorted(r["tx_id"] for r in valid.collect()) == [1, 3, 4]
    assert [(r["tx_id"], r["reject_reason"]) for r in rejected.collect()] == [(2, "negative amount")]
    valid, rejected = validate(df, amount_required=True)
    assert sorted(r["tx_id"] for r in rejected.collect()) == [2, 4]


def test_quality_gates_on_bad_and_empty_input(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "3")], "Time string, Amount string")
    gates = {r["gate"]: (r["n_failed"], r["passed"]) for r in quality_gates(df).collect()}
    assert gates == {"required_columns": (1, False), "not_empty": (0, True), "parsable": (1, False)}
    empty = spark.createDataFrame([], "Time double, Amount double, Class int")
    gates = {r["gate"]: r["passed"] for r in quality_gates(empty).collect()}
    assert gates == {"required_columns": True, "not_empty": False, "parsable": True}


def test_load_audit_counts(spark):
    rows = [(1, 1.0, 0), (2, 1.0, 0), (3, 2.0, 1), (4, math.nan, 1), (5, None, 1)]
    audit = load_audit(spark.createDataFrame(rows, "tx_id long, Amount double, Class int")).first()
    assert audit["n_rows"] == 5
    assert audit["duplicates_dropped"] == 2  # one copy of the first row, one of the missing amount
    assert (audit["incomplete_dropped"], audit["n_clean"]) == (1, 2)
    assert audit["fraud_pct"] == 60.0


def test_load_audit_of_nothing(spark):
    audit = load_audit(spark.createDataFrame([], "tx_id long, Amount double, Class int")).first()
    assert (audit["n_rows"], audit["n_clean"], audit["fraud_pct"]) == (0, 0, None)

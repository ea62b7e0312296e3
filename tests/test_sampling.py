import hashlib
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.operators import sampling
from riskloom.operators.sampling import (
    MixPart,
    bootstrap,
    class_mix,
    of_class,
    stack,
    stratified_split,
    train_sizes,
)
from riskloom.operators.weights import balanced_weights, with_balanced_weight


@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=4), st.sampled_from([0.2, 0.25, 0.5]))
def test_train_sizes(counts, fraction):
    by_class = dict(enumerate(counts))
    sizes = train_sizes(by_class, fraction)
    assert sum(sizes.values()) == sum(counts) - math.ceil(sum(counts) * fraction)
    assert all(0 <= sizes[c] <= by_class[c] for c in by_class)


def labelled(spark, n, every=7):
    return spark.range(n).select(
        F.col("id").alias("tx_id"), (F.col("id") % every == 0).cast("int").alias("Class")
    )


@pytest.mark.parametrize("few", [10_000, 5])
def test_split_is_exact_and_complete(spark, few, monkeypatch):
    """Equal to ranking each class by its digests, also when the cut is found over many rounds."""
    monkeypatch.setattr(sampling, "_FEW", few)
    monkeypatch.setattr(sampling, "_DIGITS", 1)
    train, test = stratified_split(labelled(spark, 3_000).repartition(5))
    got = {r["tx_id"]: r["Class"] for r in test.collect()}
    rest = {r["tx_id"] for r in train.collect()}
    assert rest.isdisjoint(got) and len(rest) + len(got) == 3_000
    assert len(got) == 600
    for c in (0, 1):
        ids = [i for i in range(3_000) if (i % 7 == 0) == bool(c)]
        ids.sort(key=lambda i: hashlib.md5(f"42|split|{i}".encode()).hexdigest())
        mine = {i for i, k in got.items() if k == c}
        assert mine == set(ids[: len(mine)])


def test_split_of_one_tiny_class(spark):
    train, test = stratified_split(labelled(spark, 20, every=20))
    assert (train.count(), test.count()) == (16, 4)


def test_split_plan_has_no_shuffle(spark):
    train, _ = stratified_split(labelled(spark, 100))
    assert "Exchange" not in train._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_size_is_fixed(spark):
    df = spark.range(4).withColumnRenamed("id", "tx_id")
    for n in (1, 4, 50):
        rows = bootstrap(df, n).collect()
        assert sorted(r["draw"] for r in rows) == list(range(n))
        assert {r["tx_id"] for r in rows} <= {0, 1, 2, 3}
    with pytest.raises(ValueError, match="empty"):
        bootstrap(df.limit(0), 3)


def test_bootstrap_large_path_gives_the_same_rows(spark, monkeypatch):
    df = spark.range(300).withColumnRenamed("id", "tx_id")
    few = {r["draw"]: r["tx_id"] for r in bootstrap(df, 500).collect()}
    monkeypatch.setattr(sampling, "_FEW", 10)
    assert few == {r["draw"]: r["tx_id"] for r in bootstrap(df, 500).collect()}


def test_class_mix_counts_and_order(spark):
    df = labelled(spark, 200).withColumn("Time", (F.col("tx_id") * 13 % 200).cast("double"))
    rows = class_mix(df, MixPart(30), MixPart(9, {"Time": F.lit(5.0)}), "time").collect()
    assert sorted(r["mix_id"] for r in rows) == list(range(39))
    assert sum(r["tx_id"] % 7 == 0 for r in rows) == 9
    by_row = sorted(rows, key=lambda r: r["row"])
    assert [r["Time"] for r in by_row] == sorted(r["Time"] for r in rows)
    only = class_mix(df, MixPart(0), MixPart(4)).collect()
    assert len(only) == 4 and all(r["tx_id"] % 7 == 0 for r in only)


def test_partition_and_stack(spark):
    df = labelled(spark, 70)
    parts = [of_class(df, c) for c in (0, 1)]
    assert "Class" not in parts[0].columns
    assert stack(*parts).count() == 70
    assert stack(parts[0], parts[0]).count() == 120


def test_balanced_weights(spark):
    df = labelled(spark, 70)
    got = {r["Class"]: r["weight"] for r in balanced_weights(df).collect()}
    assert got == {0: 70 / (2 * 60), 1: 70 / (2 * 10)}
    total = with_balanced_weight(df).agg(F.sum("weight")).first()[0]
    assert math.isclose(total, 70)


def test_draws_reach_every_row_of_a_large_table(spark):
    from riskloom.functions.hashing import integer_below

    drawn = spark.range(20_000).select(integer_below(2**40, 1, "t", F.col("id")).alias("i"))
    assert drawn.select((F.col("i") % 16).alias("r")).distinct().count() == 16

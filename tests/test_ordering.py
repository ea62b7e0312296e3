import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.ordering import (
    places_of,
    rows_at,
    running_sum,
    shuffled,
    thin,
    time_sorted,
    with_row,
)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_rows_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(5_000).select((F.col("id") * 7 % 5_000).alias("tx_id")).repartition(partitions)
    rows = with_row(df).collect()
    assert len(rows) == 5_000
    assert all(r["row"] == r["tx_id"] + 1 for r in rows)


def test_rows_of_an_empty_frame(spark):
    assert with_row(spark.createDataFrame([], "tx_id long")).collect() == []


def test_one_hot_order_value_is_still_a_total_order(spark):
    df = spark.range(3_000).select(F.col("id").alias("tx_id"), F.lit(1.0).alias("Time"))
    rows = time_sorted(df).collect()
    assert all(r["row"] == r["tx_id"] + 1 for r in rows)


def test_running_sum_per_group(spark):
    rng = np.random.default_rng(0)
    rows = [(g, i, int(rng.integers(0, 9))) for g in "ab" for i in range(700)]
    df = spark.createDataFrame(rows, "g string, i int, n long").repartition(7)
    got = running_sum(df, [F.desc("i")], ["n"], ("g",)).collect()
    for g in "ab":
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: -r["i"])
        values = [r["n"] for r in mine]
        assert [r["n_sum"] for r in mine] == list(np.cumsum(values))
        assert [r["n_next"] for r in mine] == [*values[1:], None]


@pytest.mark.parametrize("small", [10, 1_000_000])
def test_rows_at(spark, small):
    keys = np.random.default_rng(1).permutation(20_000)[:6_000]
    df = spark.createDataFrame([(int(k),) for k in keys], "tx_id long").repartition(6)
    wanted = [1, 2, 17, 3_000, 5_999, 6_000]
    got = {r["row"]: r["tx_id"] for r in rows_at(df, wanted, small=small).collect()}
    ordered = sorted(int(k) for k in keys)
    assert got == {w: ordered[w - 1] for w in wanted}


def test_rows_at_reads_few_buckets(spark):
    """Beyond the small size only buckets with a wanted row are sorted."""
    from riskloom.operators.ordering import _only_buckets_of

    df = spark.range(50_000).withColumnRenamed("id", "tx_id")
    kept, moved = _only_buckets_of(df, [10, 40_000], "tx_id")
    assert kept.count() < 100
    assert [true for _, true in moved] == [10, 40_000]


@pytest.mark.parametrize("shift", [0, 2**60])
def test_places_of_a_few_rows(spark, shift):
    """Neighbouring keys beyond 2**53 look equal as doubles and must still get their own places."""
    keys = [int(k) + shift for k in np.random.default_rng(2).permutation(4_000)[:1_500]]
    df = spark.createDataFrame([(k, str(k)) for k in keys], "tx_id long, name string").repartition(5)
    few = df.filter("tx_id % 50 < 2")
    ordered = sorted(keys)
    got = places_of(df, few).collect()
    assert len(got) == few.count() > 10
    assert all(ordered[r["row"] - 1] == r["tx_id"] == int(r["name"]) for r in got)
    assert places_of(df, few.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("n", "points"), [(1, 1), (199, 199), (200, 200), (399, 399), (400, 200), (1_000, 200), (1_399, 234)]
)
def test_thin(spark, n, points):
    got = sorted(r["row"] for r in thin(spark.range(n).withColumnRenamed("id", "tx_id")).collect())
    step = max(1, n // 200)
    assert got == list(range(1, n + 1, step))
    assert len(got) == points


def test_shuffle_is_seeded_and_complete(spark):
    df = spark.range(500).withColumnRenamed("id", "tx_id")
    one = {r["tx_id"]: r["row"] for r in shuffled(df, 42).collect()}
    again = {r["tx_id"]: r["row"] for r in shuffled(df.repartition(9), 42).collect()}
    other = {r["tx_id"]: r["row"] for r in shuffled(df, 43).collect()}
    assert one == again != other
    assert sorted(one.values()) == list(range(1, 501))

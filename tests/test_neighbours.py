import numpy as np
import pytest

from riskloom.operators import neighbours
from riskloom.operators.joins import join_unique
from riskloom.operators.neighbours import nearest_neighbours


def brute_force(ids, points, k):
    out = {}
    for i, p in zip(ids, points):
        d2 = np.zeros(len(points))
        for j in range(points.shape[1]):
            d2 += (p[j] - points[:, j]) ** 2
        order = [int(ids[q]) for q in np.lexsort((ids, d2)) if ids[q] != i]
        out[int(i)] = order[:k]
    return out


def found(spark, ids, points, k, **options):
    rows = [(int(i), [float(x) for x in p]) for i, p in zip(ids, points)]
    df = spark.createDataFrame(rows, "tx_id long, features array<double>").repartition(4)
    out = {}
    for r in nearest_neighbours(df, k, **options).collect():
        out.setdefault(r["id"], {})[r["nn_rank"]] = r["nn_id"]
    return {i: [near[n] for n in sorted(near)] for i, near in out.items()}


@pytest.mark.parametrize(
    "options", [{}, {"block_rows": 50}, {"block_rows": 50, "max_pivots": 2}, {"block_rows": 7}]
)
def test_equals_brute_force_with_hot_copies_and_ties(spark, options):
    """A third of the points are copies of one point, a third lie on a grid with many ties."""
    rng = np.random.default_rng(5)
    points = np.vstack(
        [
            rng.normal(size=(150, 3)),
            np.tile([[1.0, 1.0, 1.0]], (150, 1)),
            np.round(rng.normal(size=(150, 3))),
        ]
    )
    ids = rng.permutation(len(points)) * 3 + 1
    assert found(spark, ids, points, 5, **options) == brute_force(ids, points, 5)


def test_clusters_in_many_dimensions(spark):
    rng = np.random.default_rng(6)
    points = np.vstack([rng.normal(size=(200, 28)), 9 + rng.normal(size=(100, 28)) * 0.1])
    ids = np.arange(300)
    assert found(spark, ids, points, 4, block_rows=40) == brute_force(ids, points, 4)


def test_separate_clusters_visit_few_cells(spark):
    rng = np.random.default_rng(8)
    points = np.vstack([rng.normal(size=(60, 2)) + 50 * c for c in range(6)])
    ids = rng.permutation(360)
    assert found(spark, ids, points, 5, block_rows=30) == brute_force(ids, points, 5)


def test_even_spread_compares_all_blocks(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(300, 28))
    ids = rng.permutation(300)
    assert found(spark, ids, points, 5, block_rows=60) == brute_force(ids, points, 5)


def test_far_offset_does_not_hide_small_distances(spark):
    """Rough distances lose digits when values are large; the exact ones decide."""
    rng = np.random.default_rng(10)
    points = 1e6 + rng.normal(size=(200, 5)) * 1e-3
    ids = np.arange(200)
    for options in ({}, {"block_rows": 40}):
        assert found(spark, ids, points, 5, **options) == brute_force(ids, points, 5)


@pytest.mark.parametrize("task_rows", [40, 150])
def test_many_regions_and_few_task_rows(spark, task_rows):
    """Small blocks do not make more tasks: rows move once per part that a region's bound reaches."""
    rng = np.random.default_rng(11)
    points = np.vstack([rng.normal(size=(250, 4)), rng.normal(size=(150, 4)) + 30, np.ones((60, 4))])
    ids = rng.permutation(len(points))
    wanted = brute_force(ids, points, 5)
    assert found(spark, ids, points, 5, block_rows=16, task_rows=task_rows) == wanted
    assert found(spark, ids, points, 5, block_rows=16, task_rows=task_rows, max_pivots=3) == wanted


def test_a_task_is_a_pair_of_parts_not_of_blocks(spark, monkeypatch):
    layouts, plain = [], neighbours.small_frame
    monkeypatch.setattr(neighbours, "small_frame", lambda s, rows, t: layouts.append((t, rows)) or plain(s, rows, t))
    points = np.random.default_rng(12).normal(size=(600, 5))
    ids = np.arange(600)
    assert found(spark, ids, points, 5, block_rows=8, task_rows=200) == brute_force(ids, points, 5)
    tasks = [sum(a * b for _, a, b in rows) for schema, rows in layouts if "query_parts" in schema]
    assert len(tasks) == 2 and max(tasks) <= 60


def test_missing_coordinates_and_ids_leave_other_points_alone(spark):
    rng = np.random.default_rng(13)
    points = rng.normal(size=(200, 3))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    odd = [(1000 + i, [float(i), None, 0.5 if i % 2 else float("nan")]) for i in range(6)]
    odd += [(2000, None), (None, [50.0, 50.0, 50.0])]
    df = spark.createDataFrame(rows + odd, "tx_id long, features array<double>").repartition(4)
    wanted = brute_force(np.arange(200), points, 4)
    for options in ({}, {"block_rows": 12, "task_rows": 60}):
        got = {}
        for r in nearest_neighbours(df, 4, **options).orderBy("nn_rank").collect():
            got.setdefault(r["id"], []).append(r["nn_id"])
        assert got == wanted


def test_fewer_points_than_neighbours(spark):
    points = np.array([[0.0], [1.0], [3.0]])
    assert found(spark, [1, 2, 3], points, 5) == {1: [2, 3], 2: [1, 3], 3: [2, 1]}


def test_hot_join_key(spark):
    left = spark.range(9_000).selectExpr("id", "if(id % 3 = 0, 0, id) as k").cache()
    right = spark.range(9_000).selectExpr("id as k", "id * 2 as twice")
    rows = join_unique(left, right, "k").collect()
    assert len(rows) == 9_000
    assert all(r["twice"] == 2 * r["k"] for r in rows)

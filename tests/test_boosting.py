"""Second-order boosting against a plain version, flat trees, local scoring, and published versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskloom.operators import boosting
from riskloom.operators.boosting import BoostedTrees, Boosting, Tree, fit_trees
from riskloom.operators.models import (
    BOOSTED,
    FOREST,
    LOGISTIC,
    as_pipeline,
    fit_boosted,
    fit_forest,
    fit_logistic,
    importance,
    scorer_for,
)
from riskloom.operators.scaling import fit_scaler
from riskloom.operators.sketches import Sketch, column_sketches, load_sketches, save_sketches
from riskloom.operators.trees import FlatTrees
from riskloom.plans.scoring import score_rows
from riskloom.plans.serving import Served, load_local
from riskloom.schema import FEATURES, KEY, LABEL
from riskloom.sources import artifacts as store
from riskloom.sources.artifacts import Artifacts, load_artifacts, save_artifacts
from riskloom.storage import new_path
from riskloom.streaming import live

FIT = Boosting(rounds=4, depth=3, rate=0.3, bins=16, min_child=0.5, seed=3)


@pytest.fixture(scope="module")
def vectors(spark, learnable):
    x = F.array(*FEATURES)
    from pyspark.ml.functions import array_to_vector

    rows = learnable.select(KEY, LABEL, array_to_vector(x).alias("features"))
    return rows.withColumn("weight", F.when(F.col(LABEL) == 1, 5.0).otherwise(1.0)).cache()


def plain_fit(rows, fit, unit):
    """The same trees by loops over rows, nodes, columns and cuts, in whole numbers."""
    x = np.array([r["features"].toArray() for r in rows])
    y = np.array([float(r[LABEL]) for r in rows])
    w = np.array([r["weight"] for r in rows])
    key = np.array([r[KEY] for r in rows], np.int64)
    cuts = [Sketch.of(x[:, c], w).cuts(fit.bins - 1) for c in range(x.shape[1])]
    margin, trees = np.zeros(len(y)), []
    for number in range(fit.rounds):
        p = 1 / (1 + np.exp(-margin))
        g = [int(v) for v in np.rint(w * (p - y) * unit)]
        h = [int(v) for v in np.rint(w * np.maximum(p * (1 - p), 1e-16) * unit)]
        drawn = np.flatnonzero(fit.drawn(key, number)).tolist()
        columns = fit.columns_of(number, x.shape[1]).tolist()
        splits, values, members = {}, {}, {0: list(range(len(y)))}
        score = lambda rows: sum(g[i] for i in rows) / unit, lambda rows: 0
        open_nodes = [0]
        inside = set(drawn)

        def leaf(rows):
            gs, hs = sum(g[i] for i in rows) / unit, sum(h[i] for i in rows) / unit
            return -fit.rate * gs / (hs + fit.penalty), gs * gs / (hs + fit.penalty), hs

        del score
        values[0] = leaf([i for i in members[0] if i in inside])[0]
        for _ in range(fit.depth):
            following = []
            for node in open_nodes:
                here = [i for i in members[node] if i in inside]
                parent, best = leaf(here)[1], (1e-12, None)
                for c in columns:
                    for cut in cuts[c]:
                        left = [i for i in here if x[i, c] <= cut]
                        right = [i for i in here if x[i, c] > cut]
                        (_, a, ha), (_, b, hb) = leaf(left), leaf(right)
                        gain = (a + b - parent) / 2
                        if ha >= fit.min_child and hb >= fit.min_child and gain > best[0] + 1e-9:
                            best = (gain, (c, float(cut), leaf(left)[0], leaf(right)[0]))
                if best[1]:
                    c, cut, low, high = best[1]
                    splits[node] = (c, cut)
                    for child, side, value in ((2 * node + 1, True, low), (2 * node + 2, False, high)):
                        members[child] = [i for i in members[node] if (x[i, c] <= cut) == side]
                        values[child] = value
                        following.append(child)
            open_nodes = following
        for node, value in values.items():
            if node not in splits:
                margin[members[node]] += value
        trees.append((splits, values))
    return trees, margin


def test_trees_equal_the_plain_version(spark, vectors):
    some = vectors.where(f"{KEY} < 400")
    model = fit_trees(some.repartition(3), FIT)
    trees, margin = plain_fit(some.collect(), FIT, 2.0**30)
    by_tree = {}
    for tree, node, feature, cut, low, high, value in model.trees.rows():
        by_tree.setdefault(tree, {})[node] = (feature, cut, low, high, value)
    for number, (splits, values) in enumerate(trees):
        walk = [(0, 0)]
        for mine, theirs in walk:
            feature, cut, low, high, value = by_tree[number][mine]
            assert (low >= 0) == (theirs in splits)
            if low >= 0:
                assert (feature, cut) == splits[theirs]
                walk += [(low, 2 * theirs + 1), (high, 2 * theirs + 2)]
            else:
                assert value == pytest.approx(values[theirs], abs=1e-12)
    x = np.array([r["features"].toArray() for r in some.collect()])
    assert np.allclose(model.probability(x), 1 / (1 + np.exp(-margin)), atol=1e-12)


def test_trees_do_not_depend_on_partitions(vectors):
    one, many = fit_trees(vectors.coalesce(1), FIT), fit_trees(vectors.repartition(7, KEY), FIT)
    assert one.trees.rows() == many.trees.rows()


def test_no_shuffle_of_rows_after_binning(spark, vectors, monkeypatch):
    """Levels move sums only: the pages keep their partitions."""
    seen = []
    plain = boosting._grow

    def grow(pages, *rest):
        seen.append((pages.getNumPartitions(), pages.glom().map(len).collect()))
        return plain(pages, *rest)

    monkeypatch.setattr(boosting, "_grow", grow)
    fit_trees(vectors.repartition(5, KEY), FIT)
    assert len(seen) == 1 and sum(seen[0][1]) <= seen[0][0]


def test_the_driver_gets_picks_not_sums(vectors, monkeypatch):
    """What reaches the driver per level is a few numbers per node and group of columns, not a sum per bin."""
    seen = []
    plain = boosting.split

    def split(tree, level, picks, fit):
        seen.append((level, [p.shape for p in picks]))
        return plain(tree, level, picks, fit)

    monkeypatch.setattr(boosting, "split", split)
    fit_trees(vectors.coalesce(1), FIT)
    monkeypatch.setattr(boosting, "PAGE_ROWS", 400)  # several partitions: groups of columns
    fit_trees(vectors.repartition(4, KEY), FIT)
    assert seen and all(shape == (2**level, 9) for level, shapes in seen for shape in shapes)
    assert {len(shapes) for _, shapes in seen} > {1}


def test_boosting_learns_and_scores_alike(spark, learnable, vectors):
    model = fit_boosted(vectors.drop("weight"), rounds=15)
    rows = learnable.select(KEY, LABEL, *FEATURES)
    scored = scorer_for(as_pipeline(model))(rows)
    got = {r[KEY]: (r["p"], r["prediction"]) for r in scored.select(KEY, "p", "prediction").collect()}
    data = rows.collect()
    x = np.array([[r[c] for c in FEATURES] for r in data])
    p = model.probability(x)
    assert all(abs(got[r[KEY]][0] - q) < 1e-12 and got[r[KEY]][1] == int(q > 0.5) for r, q in zip(data, p))
    labels = np.array([r[LABEL] for r in data])
    assert p[labels == 1].min() > np.median(p[labels == 0])
    strongest = importance(model).collect()
    assert len(strongest) == 15 and sum(importance(model, 30).toPandas().importance) == pytest.approx(1)


def test_odd_training_rows(spark):
    schema = f"{KEY} long, {LABEL} int, features struct<a:int>, weight double"
    with pytest.raises(ValueError, match="no rows"):
        rows = spark.createDataFrame([(1, 0, Vectors.dense([0.0] * 30), 0.0)], [KEY, LABEL, "features", "weight"])
        fit_trees(rows.where(f"{KEY} = 2"), FIT)
    rows = [(i, 0, Vectors.dense([1.0] * 30), 1.0) for i in range(20)]  # one class, constant columns
    model = fit_trees(spark.createDataFrame(rows, [KEY, LABEL, "features", "weight"]), FIT)
    assert model.trees.depth == 0 and 0 < model.probability(np.ones((1, 30)))[0] < 0.5
    del schema


def test_missing_values_go_to_the_high_side(spark):
    tree = Tree.empty(1)
    tree.column[0], tree.bin[0] = 2, 1
    tree.value[1:3] = -1.0, 1.0
    model = boosting._finished([tree], [np.array([0.0, 5.0])] * 30, 30)
    x = np.zeros((3, 30))
    x[1, 2], x[2, 2] = 6.0, np.nan
    assert np.allclose(model.trees.leaves(x)[:, 0], [-1, 1, 1])
    assert [float(model.trees.leaves_of_one(r)[0]) for r in x] == [-1, 1, 1]


def test_sketches(spark):
    draw = np.random.default_rng(1)
    values = np.concatenate([draw.normal(size=30_000), np.full(10_000, 0.25), [np.nan]])
    weights = draw.integers(1, 5, len(values)).astype(float)
    exact = Sketch.of(np.array([3.0, 1.0, 1.0, np.nan]), np.array([1.0, 2.0, 3.0, 9.0]))
    assert exact.values.tolist() == [1, 3] and exact.weights.tolist() == [5, 1] and exact.error == 0
    one = Sketch.of(values[:20_000], weights[:20_000], 256)
    both = one.merge(Sketch.of(values[20_000:], weights[20_000:], 256), 256)
    assert both.total == pytest.approx(weights[:-1].sum())
    order = np.argsort(values[:-1])
    ranks = np.cumsum(weights[:-1][order])
    for share in (0.01, 0.3, 0.5, 0.9):
        v = both.quantile(share)
        low = weights[:-1][values[:-1] < v].sum()
        high = weights[:-1][values[:-1] <= v].sum()
        assert low - both.error <= share * ranks[-1] <= high + both.error
    rows = [(float(v), float(w)) for v, w in zip(values[:5000], weights)]
    df = spark.createDataFrame(rows, "x double, w double").withColumn("none", F.lit(None).cast("double"))
    found = column_sketches(df.repartition(4), ["x", "none"], "w", 128)
    assert found["none"].total == 0 and found["x"].total == pytest.approx(weights[:5000].sum())
    assert len(found["x"].values) <= 128 and found["x"].error < 0.1 * found["x"].total
    path = new_path(spark, "sketches")
    save_sketches(spark, path, {"x": found["x"]})
    back = load_sketches(spark, path)["x"]
    assert np.array_equal(back.values, found["x"].values) and back.error == found["x"].error


@pytest.fixture(scope="module")
def three(learnable, vectors):
    train = vectors.drop("weight")
    return {
        LOGISTIC: fit_logistic(train),
        FOREST: fit_forest(train, trees=12),
        BOOSTED: fit_boosted(train, rounds=6),
    }


@pytest.mark.parametrize("name", [LOGISTIC, FOREST, BOOSTED])
def test_local_scores_equal_the_batch(spark, learnable, three, name):
    out = new_path(spark, "local-artifacts")
    scaler = fit_scaler(learnable)
    save_artifacts(spark, out, Artifacts(as_pipeline(three[name]), scaler, {"Amount": 1.0}))
    scorer = scorer_for(load_artifacts(spark, out).model)
    rows = learnable.select(KEY, *FEATURES)
    batch = {r[KEY]: r for r in score_rows(rows, scorer, scaler).collect()}
    local = load_local(spark, out)
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    for r in rows.collect():
        x = {c: r[c] for c in FEATURES}
        got, want = local(x), batch[r[KEY]]
        assert abs(local.probability(local.features(x)) - want["p"]) < 1e-12
        assert {k: want[k] for k in got} == got
    assert len(jobs.getJobIdsForGroup(None)) <= before + 1  # the rows' own
    for bad in ({}, {"Amount": -1}, {"Amount": None}, {"Amount": float("nan")}, {"Amount": 1, "V1": float("inf")}):
        with pytest.raises(ValueError):
            local(bad)
    assert local({"Amount": 5.0, "other": "x", "V3": None})["label"] in ("FRAUD", "LEGIT")


def constant(p):
    """A model that gives every row one probability."""
    return BoostedTrees(float(np.log(p / (1 - p))), FlatTrees.of([(0, 0, 0, 0.0, -1, -1, 0.0)]))


def saved(spark, out, p, scaler):
    return save_artifacts(spark, out, Artifacts(constant(p), scaler, {}))


def test_a_publish_that_is_cut_leaves_the_old_version(spark, separable, monkeypatch):
    out, scaler = new_path(spark, "versions"), fit_scaler(separable)
    first = saved(spark, out, 0.9, scaler)
    held = Served(spark, out)
    assert held({"Amount": 1.0})["version"] == first
    with monkeypatch.context() as m:
        m.setattr(store, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError))
        with pytest.raises(RuntimeError):
            saved(spark, out, 0.1, scaler)
        m.setattr(BoostedTrees, "save", lambda *_: (_ for _ in ()).throw(OSError))
        with pytest.raises(OSError):
            saved(spark, out, 0.1, scaler)
    assert not held.refresh() and load_artifacts(spark, out).version == first
    second = saved(spark, out, 0.2, scaler)
    assert held.refresh() and held({"Amount": 1.0}) == {
        "fraud_probability": 0.2, "risk_score": 20.0, "label": "LEGIT", "confidence": "SAFE", "version": second,
    }
    assert load_local(spark, out, first)({"Amount": 1.0})["fraud_probability"] == 0.9
    with pytest.raises(FileExistsError):
        store.publish(spark, out, second)
    store.drop_versions(spark, out, keep=1)
    assert store._names(spark, f"{out}/versions") == [second] == store._names(spark, f"{out}/current")


def test_a_new_champion_takes_over_while_the_stream_runs(spark, separable):
    out, incoming, sink = (new_path(spark, n) for n in ("champion", "feed", "served"))
    scaler = fit_scaler(separable)
    first = saved(spark, out, 0.9, scaler)
    rows = separable.select(KEY, *FEATURES)
    rows.where(f"{KEY} < 100").coalesce(1).write.mode("append").parquet(incoming)
    stream = spark.readStream.schema(rows.schema).parquet(incoming)
    query = live.serve(stream, out, sink, processingTime="0 seconds")
    try:
        query.processAllAvailable()
        second = saved(spark, out, 0.1, scaler)
        rows.where(f"{KEY} >= 100").withColumn("Amount", F.when(F.col(KEY) == 200, -1.0).otherwise(F.col("Amount"))).coalesce(
            1
        ).write.mode("append").parquet(incoming)
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r[KEY]: r for r in spark.read.parquet(sink).collect()}
    assert len(got) == 384 == spark.read.parquet(sink).count()
    assert all(r["model_version"] == (first if k < 100 else second) for k, r in got.items())
    assert got[1]["label"] == "FRAUD" and got[300]["label"] == "LEGIT" and got[200]["reject_reason"]


def at(minute, second=0):
    return dt.datetime(2024, 5, 1, 10, minute, second)


def test_totals_per_window_with_late_rows_set_aside(spark):
    feed, out = new_path(spark, "feed"), new_path(spark, "windows")
    schema = "id long, at timestamp, label string"
    batches = [
        [(1, at(0), "FRAUD"), (2, at(4), "LEGIT"), (2, at(4), "LEGIT"), (3, None, "LEGIT")],
        [(1, at(0), "FRAUD"), (4, at(1), "FRAUD"), (5, at(21), "LEGIT")],  # a repeat, an early row
        [(6, at(2), "FRAUD"), (7, at(19), "FRAUD"), (5, at(21), "LEGIT")],  # 6 is late by then
        [(8, at(40), "LEGIT")],
        [(9, at(21), "LEGIT"), (10, at(41), "FRAUD")],
    ]
    stream = spark.readStream.schema(schema).parquet(f"{feed}/*")
    state = new_path(spark, "state")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{feed}/{i}")
        live.totals_and_late(stream, "id", "at", "5 minutes", "10 minutes", out, state).awaitTermination()
    late = {(r["id"], r["reason"]) for r in spark.read.parquet(f"{out}/late").collect()}
    assert late == {(3, "no time"), (6, "late"), (9, "late")}
    totals = {r["window_start"].minute: tuple(r)[2:] for r in live.read_totals(spark, out).collect()}
    assert totals == {0: (3, 2, 1, 66.6667), 15: (1, 1, 0, 100.0), 20: (1, 0, 1, 0.0), 40: (2, 1, 1, 50.0)}
    kept = [r["id"] for r in spark.read.parquet(f"{out}/keys").collect()]
    assert set(kept) <= {7, 8, 10}  # keys of closed windows are gone
    # An attempt that was cut is made again: the same batch number writes the same.
    native = live.windowed_totals(spark.createDataFrame(sum(batches[:1], []), schema), "at", "5 minutes", "10 minutes")
    assert {r["window_start"].minute: r["total_rows"] for r in native.collect()} == {0: 3}

"""Draws by splitting, keyed places, medians in two scans, the digest ledger, score histograms, limits."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import draws
from riskloom.operators.cleaning import dedup
from riskloom.operators.draws import feistel_place, multinomial_draws, split_draws
from riskloom.operators.evaluation import roc_auc
from riskloom.operators.ledger import DigestLedger, content_digest
from riskloom.operators.medians import exact_medians, medians_in_two_scans
from riskloom.operators.ordering import places_of, rows_at, thin
from riskloom.operators.sampling import stratified_split, train_sizes, with_part
from riskloom.operators.score_histogram import auc_bounds, merge_histograms, roc_of_bins, score_histogram
from riskloom.operators.sketches import Sketch, column_sketches
from riskloom.operators.weights import balanced_weights, with_balanced_weight
from riskloom.schema import KEY
from riskloom.storage import made_since, materialise, new_path


def times(df):
    return Counter(r["k"] for r in df.select("k").collect())


@pytest.fixture(scope="module")
def pool(spark):
    return materialise(spark.range(5_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).repartition(6), "pool")


def test_draws_are_exact_and_repeatable(spark, pool):
    found = multinomial_draws(pool, 20_000, seed=5, written=True)
    rows = found.collect()
    assert len(rows) == 20_000 and all(r["v"] == 2 * r["k"] for r in rows)
    assert len({(r["k"], r["copy"]) for r in rows}) == 20_000
    seen = Counter(r["k"] for r in rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # other splits, other tasks
    try:
        assert times(multinomial_draws(pool, 20_000, seed=5, written=True)) == seen
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert times(multinomial_draws(pool, 20_000, seed=6, written=True)) != seen
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    # Each count is Binomial(n, 1 / 5000): mean 4, variance 4 (1 - 1/5000); chi square over the rows.
    counts = np.array([seen[k] for k in range(5_000)])
    chi = ((counts - 4.0) ** 2 / 4.0).sum()
    assert abs(chi - 4_999) < 5 * math.sqrt(2 * 4_999)
    assert abs((counts == 0).mean() - math.exp(-4)) < 0.01


def test_draws_of_few_and_none(spark, pool):
    assert multinomial_draws(pool, 0, written=True).count() == 0
    few = multinomial_draws(pool.where("k < 3"), 50)
    assert few.count() == 50 and set(times(few)) <= {0, 1, 2}
    with pytest.raises(ValueError):
        multinomial_draws(pool.where("k < 0"), 1).count()
    with pytest.raises(ValueError):
        multinomial_draws(pool, -1)
    assert split_draws(7, [0, 5, 0, 5], 1, "x")[::2] == [0, 0]
    assert sum(split_draws(10**12, [3] * 1000, 1, "x")) == 10**12


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_places_are_a_permutation(spark, n):
    ids = spark.range(n).select("id", feistel_place(F.col("id"), n, 9).alias("p"), feistel_place(F.col("id"), n, 8).alias("q"))
    rows = ids.collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) == sorted(r["q"] for r in rows)
    if n > 64:
        assert [r["p"] for r in rows] != [r["q"] for r in rows]
        moved = np.array([r["p"] for r in rows])
        assert abs(np.corrcoef(np.arange(n), moved)[0, 1]) < 0.4
    assert "Exchange" not in ids._jdf.queryExecution().executedPlan().toString()


def test_walks_end_for_large_n():
    for n in (2**40 + 1, 10**12):
        a, b = draws.widths(n)
        assert n <= 2 ** (a + b) < 2 * n


def test_medians_in_two_scans(spark):
    draw = np.random.default_rng(2)
    n = 20_001
    rows = [
        (float(x), float(i % 3 == 0) * 7.0, None if i % 2 else float(i), float("nan") if i % 5 else 1.5, None)
        for i, x in enumerate(draw.normal(size=n))
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5).cache()
    names = list("abcde")
    want = exact_medians(df, names)
    assert medians_in_two_scans(df, names) == want and "e" not in want
    coarse = {c: s for c, s in column_sketches(df, names, size=16).items()}
    assert medians_in_two_scans(df, names, coarse, small=50) == want
    odd, even = (column_sketches(df.where(f"pmod(hash(a), 2) = {i}"), names, size=64) for i in (0, 1))
    assert medians_in_two_scans(df, names, {c: odd[c].merge(even[c], 64) for c in names}) == want


def test_merged_sketches_stay_within_their_bound():
    draw = np.random.default_rng(4)
    parts = [draw.gamma(2, size=5_000) for _ in range(8)]
    merged = Sketch.of(parts[0], size=200)
    for x in parts[1:]:
        merged = merged.merge(Sketch.of(x, size=200), 200)
    everything = np.sort(np.concatenate(parts))
    for share in np.linspace(0.02, 0.98, 25):
        v = merged.quantile(share)
        low, high = np.searchsorted(everything, v), np.searchsorted(everything, v, side="right")
        assert low - merged.error <= share * len(everything) <= high + merged.error


SCHEMA = f"{KEY} long, a double, b string"


def batches(spark):
    rows = [
        [(1, 1.0, "x"), (2, 1.0, "x"), (3, None, "x"), (4, float("nan"), "x"), (5, 2.0, None)],
        [(6, 1.0, "x"), (7, 3.0, ""), (8, None, "x"), (9, 3.0, "")],
        [],
        [(10, 2.0, None), (11, 4.0, "1:y"), (12, 2.0, "")],
    ]
    return [spark.createDataFrame(r, SCHEMA) for r in rows]


def content(df):
    return sorted((r[KEY], r["a"], r["b"]) for r in df.collect())


def sortable(rows):
    return sorted(rows, key=str)


def test_batches_equal_all_at_once(spark):
    ledger = DigestLedger(spark, new_path(spark, "digests"))
    parts = batches(spark)
    kept = [ledger.add(b).count() for b in parts]
    assert kept == [3, 1, 0, 2]
    from riskloom.operators.cleaning import unify_missing

    whole = parts[0].unionByName(parts[1]).unionByName(parts[3])
    want = dedup(unify_missing(whole)).drop("copies")
    rows = lambda df: sortable((r[KEY], r["a"], r["b"]) for r in df.collect())
    assert rows(ledger.rows(SCHEMA)) == rows(want)


@pytest.mark.parametrize("step", ["rows", "digests", "commit"])
def test_a_batch_that_is_cut_counts_as_none(spark, monkeypatch, step):
    ledger = DigestLedger(spark, new_path(spark, "digests"))
    first, second = batches(spark)[:2]
    ledger.add(first)
    before = ledger.rows(SCHEMA).count()
    writer = type(first.write)
    plain = writer.parquet

    def cut(self, path, *rest, **more):
        if f"/{step}/" in path:
            raise RuntimeError("lost")
        return plain(self, path, *rest, **more)

    with monkeypatch.context() as m:
        m.setattr(writer, "parquet", cut)
        if step == "commit":
            m.setattr(DigestLedger, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError))
        with pytest.raises(RuntimeError):
            ledger.add(second)
    assert ledger.rows(SCHEMA).count() == before
    assert ledger.add(second).count() == 1 and ledger.add(second).count() == 0
    assert ledger.rows(SCHEMA).count() == before + 1


def test_a_batch_is_written_once(spark):
    """No table in between: kept rows stand once beside their digests, whose table keeps its form."""
    ledger = DigestLedger(spark, new_path(spark, "digests"))
    before = len(made_since())
    for b in batches(spark):
        ledger.add(b)
    assert len(made_since()) == before
    rows = ledger.rows(SCHEMA)
    want = {r["d"] for r in rows.select(content_digest(rows).alias("d")).collect()}
    held = spark.read.parquet(f"{ledger.path}/digests").select("_digest", F.col("head").cast("string")).collect()
    assert {r["_digest"] for r in held} == want and len(held) == rows.count() == 6
    assert all(r["_digest"].startswith(r["head"]) for r in held if not r["head"].isdigit())


def scored(spark, rows):
    return spark.createDataFrame(rows, "model string, p double, Class int")


def test_auc_bound_holds(spark):
    draw = np.random.default_rng(6)
    rows = [("spread", float(p), int(draw.random() < p)) for p in draw.random(3000)]
    rows += [("ties", float(round(p, 1)), int(draw.random() < p)) for p in draw.random(500)]
    rows += [("skew", float(min(1.0, 1e-5 * draw.random() + (i % 100 == 0) * 0.9)), int(i % 50 == 0)) for i in range(2000)]
    rows += [("one class", 0.5, 1), ("one class", 0.7, 1), ("edge", 1.0, 1), ("edge", 0.0, 0), ("edge", 1.2, 1), ("edge", -3.0, 0)]
    rows += [("unknown", None, 1), ("unknown", float("nan"), 0), ("unknown", 0.4, None)]
    df = scored(spark, rows).repartition(4).cache()
    exact = {r["model"]: r["roc_auc"] for r in roc_auc(df.where("Class IS NOT NULL")).collect()}
    for bins in (10, 1000):
        parts = [score_histogram(df.where(f"pmod(hash(p), 3) = {i}"), bins) for i in range(3)]
        merged = merge_histograms(*parts)
        whole = {tuple(r) for r in score_histogram(df, bins).collect()}
        assert {tuple(r) for r in merged.collect()} == whole
        for r in auc_bounds(merged).collect():
            if exact.get(r["model"]) is None:
                assert r["auc"] is None
            else:
                assert r["low"] - 1e-12 <= exact[r["model"]] <= r["high"] + 1e-12
                assert r["error"] <= {10: 0.5, 1000: 0.5}[bins]
        assert auc_bounds(merged).where("model = 'spread'").first()["error"] < {10: 0.2, 1000: 0.01}[bins]
    ends = roc_of_bins(score_histogram(df, 10)).where("model = 'spread' AND bin = 0").first()
    assert (ends["fpr"], ends["tpr"]) == (1.0, 1.0)


def test_no_limit_on_thinned_and_first_rows(spark):
    df = materialise(spark.range(60_000).select((F.col("id") * 3).alias(KEY), F.col("id").alias("v")), "rows")
    thinned = thin(df, target=30_000).orderBy("row").collect()
    assert [(r["row"], r["v"]) for r in thinned] == [(i + 1, i) for i in range(0, 60_000, 2)]
    some = list(range(1, 60_001, 4))
    assert [r["row"] for r in rows_at(df, some).orderBy("row").collect()] == some
    few = df.where("v % 3 = 0")
    placed = places_of(df, few).collect()
    assert len(placed) == 20_000 and all(r["row"] == r["v"] + 1 for r in placed)


def test_rows_without_a_label_are_a_class(spark):
    rows = [(i, None if i % 5 == 0 else i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, f"{KEY} long, Class int")
    counts = Counter(c for _, c in rows)
    sizes = train_sizes(dict(counts), 0.2)
    assert sum(sizes.values()) == 400
    parts = with_part(df).groupBy("Class", "part").count().collect()
    assert {r["Class"]: r["count"] for r in parts if r["part"] == "train"} == sizes
    train, test = stratified_split(df)
    assert train.count() + test.count() == 500 and test.where("Class IS NULL").count() == 20
    weights = {r["Class"]: r["weight"] for r in balanced_weights(df).collect()}
    assert weights[None] == pytest.approx(500 / (3 * 100))
    assert with_balanced_weight(df).where("weight IS NULL").count() == 0

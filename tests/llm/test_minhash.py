"""b-bit MinHash against brute-force groups, its estimate, and odd rows."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import minhash, sets
from riskloom.llm.queries import QUERIES

SIM = sets.Similarity(k=5, num=85)
COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def wanted(rows):
    return sorted(((*r, r[0] == r[2]) for r in brute.jaccard_groups(rows, k=5)), key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(QUERIES["op11_minhash"](spark, sf_dir)) == wanted(rows)


def test_odd_rows(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "one two three four"),
        (8, " ".join(base)), (8, " ".join(base)), (9, " ".join(base[:118])), (None, " ".join(base[:117])),
        (None, "lone words without any id at all"), (None, "lone words without any id at all"),
        (10, "z " * 4000), (11, "z " * 90), (12, " ".join(base * 300)), (13, " ".join(base[:60]) + " x " + " ".join(base[60:])),
    ]
    schema = "doc_id long, text string, n int, node string, key double"
    docs = spark.createDataFrame([(*r, 1, "clash", 0.5) for r in rows], schema).repartition(3)
    assert got(minhash.report(docs, SIM)) == wanted(rows)
    assert minhash.report(docs.limit(0), SIM).count() == 0


def test_a_large_group_and_chains_that_no_hub_joins(spark):
    """Copies of copies: far ends are unlike, so lists need several hubs."""
    draw = random.Random(3)
    text = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(150):
        text[draw.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(text[:200] + [f"end{i}"])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = got(minhash.report(docs, SIM))
    assert found == wanted(rows)


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_estimate_is_corrected_for_chance(spark, bits):
    sketch = minhash.Sketch(bits=bits)
    draw = np.random.default_rng(5)
    rows, truth = [], {}
    for i, share in enumerate([0.0, 0.3, 0.6, 0.85, 1.0]):
        pool = draw.integers(0, 2**63, 4000).astype(np.uint64)
        both = int(2000 * 2 * share / (1 + share))
        left, right = np.unique(pool[:2000]), np.unique(pool[2000 - both : 4000 - both])
        truth[i] = len(np.intersect1d(left, right)) / len(np.union1d(left, right))
        signs = minhash.packed(minhash.minima_of([left, right], sketch), sketch)
        rows.append((i, *signs[0].tolist(), *signs[1].tolist()))
    names = sketch.columns()
    frame = spark.createDataFrame(rows, ", ".join(["i int", *(f"{c} long" for c in names), *(f"r{c} long" for c in names)]))
    a = frame.select("i", *names).alias("a")
    b = frame.select("i", *[F.col(f"r{c}").alias(c) for c in names]).alias("b")
    met = a.join(b, "i").selectExpr("i", f"{sketch.estimate('a', 'b')} AS s")
    for r in met.collect():
        assert abs(r.s - truth[r.i]) < 0.17
    assert 0.5 < sketch.least_estimate(0.85) < 0.85


def test_bands_find_what_they_promise():
    """Misses at the threshold stay below one in a hundred million, by the formula of the docstring."""
    sketch = minhash.Sketch()
    assert (1 - 0.85**sketch.rows) ** sketch.bands < 1e-8

"""Every registered query against its SQL, on the whole tables of the smallest data set."""

import math

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        number = float(value) + 0.0
        return "nan" if math.isnan(number) else number
    return str(value)


def table(rows, order):
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=str)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    wanted = duck.execute(ORACLES[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(got.columns)
    names = sorted(columns)
    ours = table(got.collect(), [got.columns.index(c) for c in names])
    theirs = table(wanted.fetchall(), [columns.index(c) for c in names])
    assert len(ours) == len(theirs)
    assert ours == theirs


def test_entry(spark):
    assert driver.entry(spark).first()["total_rows"] == 1000


@pytest.mark.parametrize("name", ["train_and_save", "batch_scored_model", "feature_importance_top15"])
def test_model_queries_run(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == {"train_and_save": 3, "feature_importance_top15": 15}.get(name, 500)

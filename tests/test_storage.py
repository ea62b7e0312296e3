"""Intermediate tables: written once, kept by name, dropped at the end of their block."""

import os

from riskloom.storage import materialise, materialise_bucketed, scratch, shared_root


def folder(spark):
    path = f"{shared_root(spark).removeprefix('file:')}/riskloom"
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def tables(spark):
    return {t.name for t in spark.catalog.listTables()}


def test_scratch_drops_folders_and_tables(spark):
    before, catalog = folder(spark), tables(spark)
    with scratch(spark, keep=("kept",)):
        rows = spark.range(20).withColumnRenamed("id", "k")
        plain = materialise(rows, "plain")
        kept = materialise(plain, "kept")
        dealt = materialise_bucketed(rows, "dealt", "k", 3)
        assert dealt.count() == 20
        assert "Exchange" not in dealt.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        assert len(folder(spark) - before) == 3 and len(tables(spark) - catalog) == 1
    left = folder(spark) - before
    assert len(left) == 1 and left.pop().startswith("kept-")
    assert tables(spark) == catalog
    assert kept.count() == 20


def test_blocks_nest(spark):
    before = folder(spark)
    with scratch(spark):
        with scratch(spark, keep=("inner",)):
            inner = materialise(spark.range(3), "inner")
        assert inner.count() == 3
    assert folder(spark) == before


def test_a_failing_block_drops_too(spark):
    before = folder(spark)
    try:
        with scratch(spark):
            materialise(spark.range(3), "lost")
            raise KeyError
    except KeyError:
        pass
    assert folder(spark) == before

import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions.hashing import gaussian, gaussian_constant, integer_below, uniform
from riskloom.operators import perturb
from riskloom.plans.recipes import RECIPES, scenario


def test_draws_have_the_right_shape(spark):
    key = F.col("id")
    row = (
        spark.range(40_000)
        .select(uniform(42, "u", key).alias("u"), gaussian(42, "g", key).alias("g"), integer_below(5, 42, "i", key).alias("i"))
        .agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("g"), F.stddev("g"), F.min("i"), F.max("i"))
        .first()
    )
    low, high, mean, g_mean, g_sd, i_low, i_high = row
    assert 0 <= low < 0.001 and 0.999 < high < 1 and abs(mean - 0.5) < 0.01
    assert abs(g_mean) < 0.02 and abs(g_sd - 1) < 0.02
    assert (i_low, i_high) == (0, 4)


def test_constant_draw_equals_the_column_draw(spark):
    got = spark.range(1).select(gaussian(42, "factor-V1", F.lit("constant"))).first()[0]
    assert math.isclose(got, gaussian_constant(42, "factor-V1"), rel_tol=1e-12)


def test_draws_do_not_depend_on_partitions(spark, separable):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    one = perturb.inject_noise(separable.coalesce(1))
    many = perturb.inject_noise(separable.repartition(9))
    rounded = lambda df: df.select([F.round(c, 9) for c in df.columns])
    assert key(rounded(one)) == key(rounded(many))


def test_floors_and_whole_times(spark):
    df = spark.createDataFrame([(i, 0.0, 0.001) for i in range(200)], "tx_id long, Time double, Amount double")
    out = perturb.time_drift(perturb.amount_jitter(df), 5).collect()
    assert all(r["Amount"] == 0.01 and r["Time"] >= 0 and r["Time"] == int(r["Time"]) <= 5 for r in out)


def test_flips_change_sign_only(spark, separable):
    before = {r["tx_id"]: r for r in separable.collect()}
    after = perturb.sign_flip(separable, 0.5).collect()
    flips = sum(r["V25"] != before[r["tx_id"]]["V25"] for r in after)
    assert all(abs(r["V25"]) == abs(before[r["tx_id"]]["V25"]) for r in after)
    assert 130 < flips < 254
    assert all(r["V1"] == before[r["tx_id"]]["V1"] for r in after)


def test_constant_column_gets_unit_noise(spark):
    df = spark.range(4_000).select(F.col("id").alias("tx_id"), F.lit(3.0).alias("V1"))
    sd = perturb.gaussian_noise(df, 0.2, columns=["V1"]).agg(F.stddev("V1")).first()[0]
    assert abs(sd - 0.2) < 0.02


def test_cross_noise_is_shared(spark, separable):
    before = {r["tx_id"]: r for r in separable.collect()}
    for r in perturb.cross_noise(separable).limit(20).collect():
        gaps = [
            (r[c] - before[r["tx_id"]][c]) / (0.5 + 0.3 * gaussian_constant(42, f"factor-{c}"))
            for c in perturb.COUPLED
        ]
        assert max(gaps) - min(gaps) < 1e-9


@pytest.mark.parametrize("name", list(RECIPES))
def test_recipe_sizes(spark, separable, name):
    recipe = RECIPES[name]
    rows = scenario(separable, name).collect()
    assert len(rows) == recipe.legit + recipe.fraud
    assert sum(r["tx_id"] % 16 == 0 for r in rows) == recipe.fraud
    assert sorted(r["row"] for r in rows) == list(range(1, len(rows) + 1))


def test_plain_recipe_keeps_time(spark, separable):
    rows = scenario(separable, "card_testing", plain=True).collect()
    assert all(0 <= r["Time"] < 600 and r["Amount"] >= 0.5 for r in rows)
    by_row = sorted(rows, key=lambda r: r["row"])
    assert [r["Time"] for r in by_row] == sorted(r["Time"] for r in rows)

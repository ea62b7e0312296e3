"""Noise for robustness sets. Every draw depends on the seed, the column and the row key only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import (
    gaussian,
    gaussian_constant,
    integer_below,
    uniform,
    uniform_between,
)
from riskloom.functions.numeric import clip, whole
from riskloom.schema import FEATURES, KEY, V_COLUMNS

# Columns that may flip sign, and columns that share one noise term.
FLIPPED = ["V22", "V23", "V24", "V25", "V26", "V27", "V28"]
COUPLED = ["V1", "V2", "V3", "V4"]


def gaussian_noise(
    df: DataFrame, v_scale: float = 0.15, seed: int = 42, key: str = KEY, columns=V_COLUMNS
) -> DataFrame:
    """Add N(0, v_scale * sample std of the column); a constant column counts as std 1."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    noisy = {}
    for c in columns:
        sd = v_scale * (row[c] or 1.0)
        noisy[c] = F.col(c) + F.lit(sd) * gaussian(seed, f"noise-{c}", F.col(key))
    return df.withColumns(noisy)


def sign_flip(
    df: DataFrame, flip_prob: float = 0.08, seed: int = 42, key: str = KEY, columns=FLIPPED
) -> DataFrame:
    flips = lambda c: uniform(seed, f"flip-{c}", F.col(key)) < flip_prob
    return df.withColumns({c: F.when(flips(c), -F.col(c)).otherwise(F.col(c)) for c in columns})


def amount_jitter(df: DataFrame, pct: float = 0.10, seed: int = 42, key: str = KEY) -> DataFrame:
    """Amount times 1 + U(-pct, pct), at least 0.01, 2 digits."""
    factor = F.lit(1.0) + uniform_between(-pct, pct, seed, "amount", F.col(key))
    return df.withColumn("Amount", F.round(clip(F.col("Amount") * factor, low=0.01), 2))


def time_drift(df: DataFrame, drift: int = 300, seed: int = 42, key: str = KEY) -> DataFrame:
    """Time plus a whole number from -drift..drift, at least 0, whole."""
    shift = integer_below(2 * drift + 1, seed, "drift", F.col(key)) - drift
    return df.withColumn("Time", whole(clip(F.col("Time") + shift, low=0)))


def cross_noise(df: DataFrame, seed: int = 42, key: str = KEY, columns=COUPLED) -> DataFrame:
    """One N(0, 0.05) draw per row, times one N(0.5, 0.3) factor per column."""
    shared = F.lit(0.05) * gaussian(seed, "cross", F.col(key))
    factor = {c: 0.5 + 0.3 * gaussian_constant(seed, f"factor-{c}") for c in columns}
    return df.withColumns({c: F.col(c) + shared * F.lit(factor[c]) for c in columns})


def inject_noise(
    df: DataFrame,
    v_scale: float = 0.15,
    amount_pct: float = 0.10,
    drift: int = 300,
    flip_prob: float = 0.08,
    seed: int = 42,
    key: str = KEY,
) -> DataFrame:
    """All five perturbations in their fixed order."""
    df = gaussian_noise(df, v_scale, seed, key)
    df = sign_flip(df, flip_prob, seed, key)
    df = amount_jitter(df, amount_pct, seed, key)
    df = time_drift(df, drift, seed, key)
    return cross_noise(df, seed, key)


def plain_noise(df: DataFrame, scale: float = 0.02, seed: int = 42, key: str = KEY) -> DataFrame:
    """Add N(0, scale) to all but Time; Amount at least 0.5 with 2 digits, Time whole."""
    noisy = {
        c: F.col(c) + F.lit(scale) * gaussian(seed, f"plain-{c}", F.col(key))
        for c in FEATURES
        if c != "Time"
    }
    noisy["Amount"] = F.round(clip(noisy["Amount"], low=0.5), 2)
    return df.withColumns(noisy | {"Time": whole(F.col("Time"))})

"""Standardisation of ``Amount`` and ``Time`` by the population standard deviation."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.numeric import known
from riskloom.schema import SCALED
from riskloom.storage import small_frame


@dataclass(frozen=True)
class Scaler:
    """Two numbers per column; small enough to become literals of a projection."""

    means: dict[str, float]
    stds: dict[str, float]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, self.means[c], self.stds[c]) for c in self.means]
        return small_frame(spark, rows, "name string, mean double, std double")

    @staticmethod
    def from_frame(df: DataFrame) -> "Scaler":
        rows = df.collect()
        return Scaler({r["name"]: r["mean"] for r in rows}, {r["name"]: r["std"] for r in rows})


def fit_scaler(df: DataFrame, columns=SCALED) -> Scaler:
    """One aggregate over the training rows. A constant column is divided by 1."""
    aggregates = []
    for c in columns:
        value = known(F.col(c))
        aggregates += [F.avg(value).alias(f"{c}_mean"), F.stddev_pop(value).alias(f"{c}_std")]
    row = df.agg(*aggregates).first()
    empty = [c for c in columns if row[f"{c}_mean"] is None]
    if empty:
        raise ValueError(f"Cannot fit a scaler: no values in {empty}")
    return Scaler(
        {c: row[f"{c}_mean"] for c in columns}, {c: row[f"{c}_std"] or 1.0 for c in columns}
    )


def apply_scaler(df: DataFrame, scaler: Scaler | None) -> DataFrame:
    """Scale in place where all scaled columns are present; otherwise leave the frame alone."""
    if scaler is None:
        raise ValueError("A fitted scaler must be provided.")
    if not set(scaler.means) <= set(df.columns):
        return df
    return df.withColumns(
        {c: (F.col(c) - F.lit(scaler.means[c])) / F.lit(scaler.stds[c]) for c in scaler.means}
    )

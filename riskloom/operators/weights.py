"""Row weights for training on unequal classes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.schema import LABEL
from riskloom.storage import small_frame


def class_counts(df: DataFrame, label: str = LABEL) -> dict[int, int]:
    """Rows per class; more than a thousand classes are an error."""
    rows = df.groupBy(label).count().limit(1_001).collect()
    if len(rows) > 1_000:
        raise ValueError(f"{label} has too many values to be a class.")
    return {r[label]: r["count"] for r in rows}


def balanced_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row per class: ``n`` and ``weight = total / (classes * n)``."""
    counts = class_counts(df, label)
    total = sum(counts.values())
    rows = [(c, n, total / (len(counts) * n)) for c, n in counts.items()]
    return small_frame(df.sparkSession, rows, f"{label} int, n long, weight double")


def with_balanced_weight(df: DataFrame, label: str = LABEL, column: str = "weight") -> DataFrame:
    """Add the balanced weight; the few weights become literals, so rows stay where they are."""
    weight = F.lit(None).cast("double")
    for r in balanced_weights(df, label).collect():
        weight = F.when(F.col(label).eqNullSafe(F.lit(r[label])), r["weight"]).otherwise(weight)
    return df.withColumn(column, weight)


def with_positive_weight(
    df: DataFrame, weight: float = 100.0, label: str = LABEL, column: str = "weight"
) -> DataFrame:
    return df.withColumn(column, F.when(F.col(label) == 1, float(weight)).otherwise(1.0))

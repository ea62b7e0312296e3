"""What loading and splitting did to a table, as rows."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numeric import known, ratio
from riskloom.operators.cleaning import dedup, unify_missing
from riskloom.schema import KEY, LABEL


def load_audit(df: DataFrame, key: str = KEY, label: str = LABEL) -> DataFrame:
    """Shape, fraud share, duplicates and incomplete rows; one grouping answers all of it."""
    content = [c for c in df.columns if c != key]
    kept = dedup(unify_missing(df), key)
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in content])
    n, positives = F.sum("copies"), F.sum(F.col(label) * F.col("copies"))
    labelled = F.sum(F.when(F.col(label).isNotNull(), F.col("copies")))
    return kept.agg(
        F.coalesce(n, F.lit(0)).alias("n_rows"),
        F.lit(len(content)).alias("n_columns"),
        F.round(ratio(positives, labelled, None) * 100.0, 4).alias("fraud_pct"),
        F.coalesce(n - F.count(F.lit(1)), F.lit(0)).alias("duplicates_dropped"),
        F.count_if(~complete).alias("incomplete_dropped"),
        F.count_if(complete).alias("n_clean"),
    )


def split_audit(parts: DataFrame, label: str = LABEL) -> DataFrame:
    """``part, n_rows, fraud_pct`` of a frame with a ``part`` column, in one pass."""
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(known(F.col(label).cast("double"))) * 100.0, 4).alias("fraud_pct"),
    )

"""Joins against a side with one row per key, when a few keys may hold most rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SHARE = 1_000


def join_unique(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join; ``right`` has one row per key, keys of ``left`` may be very uneven.

    A key with more than 1/1000 of the left rows is hot, so there are fewer than 1000 of them.
    Their right rows are broadcast and the hot left rows stay where they are. The other keys, each
    below 1/1000 of the rows, go through an ordinary join. ``left`` is read three times: pass a
    written table.
    """
    counts = left.groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    total = left.count()
    hot_rows = counts.filter(F.col("n") > max(1_000, total // _SHARE)).select(on).collect()
    if not hot_rows:
        return left.join(right, on)
    hot = F.broadcast(left.sparkSession.createDataFrame(hot_rows, left.select(on).schema))
    hot_right = F.broadcast(right.join(hot, on, "left_semi"))
    cold = left.join(hot, on, "left_anti").join(right, on)
    return left.join(hot_right, on).unionByName(cold)

"""Mergeable score histograms: AUC of data that grows batch by batch, within a proven bound.

Scores fall into equal bins of [0, 1]. A pair of a positive and a negative row in different bins is
ranked by the bins; a pair in one bin counts somewhere between 0 and 1. So with P positives, N negatives
and p, n of them in a bin, the exact AUC (ties counted half) lies within ``sum(p n) / (2 P N)`` of the
value that counts every such pair half. ``evaluation.roc_auc`` is the exact way.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.numeric import known, ratio
from riskloom.schema import LABEL

BINS = 10_000


def score_histogram(scored: DataFrame, bins: int = BINS) -> DataFrame:
    """``model, bin, pos, neg`` of the bins that hold rows; unknown scores and labels are left out."""
    p = known(F.col("p"))
    bin_of = F.least(F.greatest(F.floor(p * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    model = F.col("model") if "model" in scored.columns else F.lit("model")
    rows = scored.where(p.isNotNull() & F.col(LABEL).isin(0, 1))
    return rows.groupBy(model.alias("model"), bin_of.alias("bin")).agg(
        F.count_if(F.col(LABEL) == 1).alias("pos"), F.count_if(F.col(LABEL) == 0).alias("neg")
    )


def merge_histograms(*parts: DataFrame) -> DataFrame:
    """The histogram of all rows from those of the batches."""
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("model", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def auc_bounds(histogram: DataFrame) -> DataFrame:
    """``model, auc, error, low, high``: the exact AUC lies between ``low`` and ``high``.

    NULL where a class is absent. A model has at most as many rows as there are bins.
    """
    lower = Window.partitionBy("model").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(lower), F.lit(0))
    summed = histogram.withColumn("below", below).groupBy("model").agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("won"),
        F.sum(F.col("pos") * F.col("neg") / 2.0).alias("open"),
        (F.sum("pos").cast("double") * F.sum("neg")).alias("pairs"),
    )
    auc, error = ratio(F.col("won"), F.col("pairs"), None), ratio(F.col("open"), F.col("pairs"), None)
    return summed.select(
        "model", auc.alias("auc"), error.alias("error"), (auc - error).alias("low"), (auc + error).alias("high")
    )


def roc_of_bins(histogram: DataFrame) -> DataFrame:
    """``model, bin, fpr, tpr``, rows in this bin or a higher one: points of the exact curve."""
    upto = Window.partitionBy("model").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy("model")
    return histogram.select(
        "model",
        "bin",
        ratio(F.sum("neg").over(upto), F.sum("neg").over(everything), None).alias("fpr"),
        ratio(F.sum("pos").over(upto), F.sum("pos").over(everything), None).alias("tpr"),
    )

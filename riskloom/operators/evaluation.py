"""Confusion cells, threshold metrics, exact ROC-AUC and ROC points, for one or several models.

A scored frame has ``Class`` (0/1), ``p`` and ``prediction`` (0/1), and ``model`` when it holds the
scores of several models. Models are few; rows are not.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numeric import known, ratio
from riskloom.operators.ordering import running_sum
from riskloom.schema import LABEL, METRIC_NAMES
from riskloom.storage import small_frame


def _with_model(scored: DataFrame) -> DataFrame:
    return scored if "model" in scored.columns else scored.withColumn("model", F.lit("model"))


def _cells(scored: DataFrame) -> DataFrame:
    actual, predicted = F.col(LABEL) == 1, F.col("prediction") == 1
    return scored.groupBy("model").agg(
        F.count_if(actual & predicted).alias("tp"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(~actual & ~predicted).alias("tn"),
    )


def confusion(scored: DataFrame) -> DataFrame:
    """``model, actual, predicted, n`` with all four cells, zeros kept."""
    cell = lambda actual, predicted, name: F.struct(
        F.lit(actual).alias("actual"), F.lit(predicted).alias("predicted"), F.col(name).alias("n")
    )
    cells = F.array(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))
    return _cells(_with_model(scored)).select("model", F.inline(cells))


def binary_metrics(scored: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from one pass; zero where a denominator is zero."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return _cells(_with_model(scored)).select(
        "model",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _by_score(scored: DataFrame) -> DataFrame:
    """Class counts per distinct score: ties become one row before anything is ordered."""
    return (
        _with_model(scored)
        .filter(known(F.col("p")).isNotNull())
        .groupBy("model", "p")
        .agg(F.count_if(F.col(LABEL) == 1).alias("pos"), F.count_if(F.col(LABEL) == 0).alias("neg"))
    )


def _descending(scored: DataFrame) -> DataFrame:
    return running_sum(_by_score(scored), [F.desc("p")], ["pos", "neg"], ("model",))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve per model, ties counted half; NULL when one class is absent."""
    above = F.col("neg_sum") - F.col("neg") / 2.0
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    beaten = F.sum(F.col("pos") * above)
    return (
        _descending(scored)
        .groupBy("model")
        .agg((F.lit(1.0) - ratio(beaten, pairs, None)).alias("roc_auc"))
    )


def roc_points(scored: DataFrame, drop_collinear: bool = True) -> DataFrame:
    """``model, threshold, fpr, tpr`` from (0, 0) on; the first point has no threshold.

    A point inside a straight run of the curve is dropped by default, as plotting libraries do:
    it lies there when the next lower score adds the same class counts.
    """
    steps = _descending(scored)
    same_step = (F.col("pos") == F.col("pos_next")) & (F.col("neg") == F.col("neg_next"))
    is_first = F.col("pos_sum") + F.col("neg_sum") == F.col("pos") + F.col("neg")
    is_last = F.col("pos_next").isNull()
    kept = steps.filter(is_first | is_last | ~same_step) if drop_collinear else steps
    points = kept.select(
        "model",
        F.col("p").alias("threshold"),
        ratio(F.col("neg_sum"), F.col("neg_all"), None).alias("fpr"),
        ratio(F.col("pos_sum"), F.col("pos_all"), None).alias("tpr"),
    )
    start = steps.filter(is_first).select(
        "model",
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return start.unionByName(points)


def chance_line(points: DataFrame) -> DataFrame:
    """The diagonal from (0, 0) to (1, 1), in the shape of ``roc_points``."""
    spark = points.sparkSession
    rows = [("chance", None, 0.0, 0.0), ("chance", None, 1.0, 1.0)]
    return small_frame(spark, rows, "model string, threshold double, fpr double, tpr double")


def model_metrics(scored: DataFrame, digits: int = 4) -> DataFrame:
    """All five metrics per model, rounded as they are reported."""
    both = binary_metrics(scored).join(roc_auc(scored), "model", "left")
    return both.select("model", *[F.round(c, digits).alias(c) for c in METRIC_NAMES])


def _position(names: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col("model"))


def champion(metrics: DataFrame, names: list[str]) -> DataFrame:
    """The model with the highest rounded AUC; the first listed wins a tie."""
    auc = F.round("roc_auc", 4)
    return metrics.orderBy(auc.desc_nulls_last(), _position(names)).limit(1)


def report(metrics: DataFrame, names: list[str], features: list[str]) -> DataFrame:
    """The one-row training report: champion, its AUC, feature order, metrics in listed order."""
    row = F.struct("model", *METRIC_NAMES)
    # one element per model
    listed = F.array_sort(F.collect_list(F.struct(_position(names).alias("at"), row.alias("m"))))
    best = champion(metrics, names).select(
        F.col("model").alias("best_model"), F.col("roc_auc").alias("best_roc_auc")
    )
    everything = metrics.agg(F.transform(listed, lambda x: x["m"]).alias("all_metrics"))
    return everything.select(
        best.select("best_model").scalar().alias("best_model"),
        best.select("best_roc_auc").scalar().alias("best_roc_auc"),
        F.array(*[F.lit(f) for f in features]).alias("feature_names"),
        "all_metrics",
    )

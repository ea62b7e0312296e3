"""Score transactions: align, impute, scale, predict, band. Only the row number needs a shuffle."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.risk import confidence_of, fraud_probability, label_of, risk_score
from riskloom.operators.cleaning import (
    align,
    gap_reason,
    reject_reason,
    require_columns,
    validate,
    unparsable_columns,
)
from riskloom.operators.medians import batch_medians, impute
from riskloom.operators.ordering import with_row
from riskloom.operators.scaling import Scaler, apply_scaler
from riskloom.schema import BANDS, EXPORT, FEATURES, KEY, LABEL, LOWEST_BAND
from riskloom.storage import materialise, small_frame

Scorer = Callable[[DataFrame], DataFrame]


def add_risk(scored: DataFrame, bands=BANDS, lowest=LOWEST_BAND) -> DataFrame:
    """The four result columns from ``p``."""
    p = F.col("p")
    return scored.withColumns(
        {
            "fraud_probability": fraud_probability(p),
            "risk_score": risk_score(p),
            "label": label_of(p, bands, lowest),
            "confidence": confidence_of(p, bands, lowest),
        }
    )


def _with_echo(aligned: DataFrame) -> DataFrame:
    """Keep the unscaled amount. Its final name differs from ``Amount`` by case only, so it waits."""
    if "_echo" in aligned.columns:
        return aligned
    return aligned.withColumn("_echo", F.round(F.col("Amount"), 2))


def score_rows(
    aligned: DataFrame, scorer: Scorer, scaler: Scaler, bands=BANDS, lowest=LOWEST_BAND
) -> DataFrame:
    """Score aligned rows without gaps. ``amount`` echoes the unscaled amount; a narrow plan."""
    scored = scorer(apply_scaler(_with_echo(aligned), scaler))
    kept = [c for c in (KEY, LABEL) if c in aligned.columns]
    plain = scored.select(*kept, F.col("_echo").alias("amount"), "p", "prediction")
    return add_risk(plain, bands, lowest)


def judge(df: DataFrame, medians: dict[str, float] | None = None) -> DataFrame:
    """Aligned rows with gaps filled, and ``reject_reason`` on those that cannot be scored.

    Gaps take the given medians, else those of the batch. A feature that still has no value would
    give no probability, so such rows are rejected like those with a negative amount, and text that
    is no number is rejected, not filled. Rows of ``files.judge_json`` keep their line and reason.
    """
    text = df.withColumn("_unparsable", unparsable_columns(df))
    aligned = _with_echo(align(text, keep=(KEY, LABEL, "_unparsable", "_record", "_reason")))
    told = F.col("_reason") if "_reason" in aligned.columns else F.lit(None).cast("string")
    if medians is None:
        medians = batch_medians(validate(aligned.where((F.col("_unparsable") == "") & told.isNull()))[0])
    bad = F.when(F.col("_unparsable") != "", F.concat(F.lit("not a number: "), "_unparsable"))
    reason = F.coalesce(told, bad, reject_reason(), gap_reason())
    return impute(aligned, medians).withColumn("reject_reason", reason).drop("_unparsable", "_reason")


def score_judged(
    judged: DataFrame, scorer: Scorer, scaler: Scaler, bands=BANDS, lowest=LOWEST_BAND
) -> DataFrame:
    """One narrow pass over good and rejected rows: the latter go through the model as zeros, unseen,
    and have no scores but a ``reject_reason``."""
    kept = [c for c in (KEY, "_record") if c in judged.columns]
    no_gaps = judged.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in FEATURES})
    scored = scorer(apply_scaler(no_gaps, scaler)).select(
        *kept,
        F.col("_echo").alias("amount"),
        F.when(F.col("reject_reason").isNull(), F.col("p")).alias("p"),
        "reject_reason",
    )
    return add_risk(scored, bands, lowest).select(*kept, *EXPORT[1:], "reject_reason")


def prepare(df: DataFrame, medians: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows ready to score, rejected rows). With given medians there is no job: fit for streams."""
    judged = judge(df, medians)
    is_good = F.col("reject_reason").isNull()
    return judged.filter(is_good).drop("reject_reason"), judged.filter(~is_good).drop("_echo")


def score_single(
    spark: SparkSession, transaction: dict, scorer: Scorer, scaler: Scaler, bands=BANDS, lowest=LOWEST_BAND
) -> dict:
    """Score one transaction given as a dict; absent features are 0.0, ``Amount`` is required."""
    if transaction.get("Amount") is None or transaction["Amount"] < 0:
        raise ValueError("Amount must be given and be at least 0.")
    values = {c: float(transaction.get(c) or 0.0) for c in FEATURES}
    row = small_frame(spark, [tuple(values.values())], ", ".join(f"{c} double" for c in FEATURES))
    scored = score_rows(row, scorer, scaler, bands, lowest).first()
    return {c: scored[c] for c in ("fraud_probability", "risk_score", "label", "confidence")}


def score_batch(
    df: DataFrame,
    scorer: Scorer,
    scaler: Scaler,
    medians: dict[str, float] | None = None,
    bands=BANDS,
    lowest=LOWEST_BAND,
) -> tuple[DataFrame, DataFrame]:
    """(predictions in export shape, rejected rows with ``reject_reason``). Rows need a key that
    sorts in input order; ``read_transactions(..., positions=True)`` gives one.

    ``row`` is the 1-based place of a row among all input rows in key order, rejected ones included,
    so that it points into the input. Predictions and rejects are written together, without the
    features, before they are put in order: ordering samples its input first, and from a written
    table that does not run the model a second time.
    """
    judged = judge(require_columns(df, [KEY]), medians)
    narrow = score_judged(judged, scorer, scaler, bands, lowest).drop("_record")
    everything = materialise(narrow, "scored")
    numbered = with_row(everything, KEY)
    is_scored = F.col("reject_reason").isNull()
    return (
        numbered.filter(is_scored).select(KEY, *EXPORT),
        numbered.filter(~is_scored).select(KEY, "row", "amount", "reject_reason"),
    )

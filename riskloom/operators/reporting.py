"""Summaries of a scored table: totals, shares, histogram, rankings, display subsets."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.numeric import ratio
from riskloom.functions.risk import badge
from riskloom.schema import RISK_BINS


def summary(scored: DataFrame) -> DataFrame:
    """One row: total, fraud, legit and the fraud rate in percent (4 digits, 0 when empty)."""
    counted = scored.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("label") == "FRAUD").alias("fraud_count")
    )
    total, fraud = F.col("total_rows"), F.col("fraud_count")
    return counted.select(
        "total_rows",
        "fraud_count",
        (total - fraud).alias("legit_count"),
        F.round(ratio(fraud, total) * 100.0, 4).alias("fraud_rate"),
    )


def kpis(totals: DataFrame) -> DataFrame:
    """The summary as display text."""
    thousands = lambda c: F.format_number(F.col(c), 0)
    return totals.select(
        thousands("total_rows").alias("total"),
        thousands("fraud_count").alias("fraud"),
        thousands("legit_count").alias("legit"),
        F.format_string("%.2f%%", "fraud_rate").alias("rate"),
        F.concat(
            F.lit("Showing "), thousands("total_rows"), F.lit(" transactions · "),
            F.col("fraud_count").cast("string"), F.lit(" flagged"),
        ).alias("subtitle"),
    )


def label_counts(scored: DataFrame) -> DataFrame:
    """``label, n`` for both labels, zeros kept."""
    labels = ["FRAUD", "LEGIT"]
    counted = scored.agg(*[F.count_if(F.col("label") == x).alias(x) for x in labels])
    rows = [F.struct(F.lit(x).alias("label"), F.col(x).alias("n")) for x in labels]
    return counted.select(F.inline(F.array(*rows)))


def histogram(scored: DataFrame, bins=RISK_BINS) -> DataFrame:
    """``bin, low, high, n`` over half-open risk-score bins, zeros kept; one aggregate, no join."""
    score = F.col("risk_score")
    counted = scored.agg(
        *[F.count_if((score >= low) & (score < high)).alias(f"n{i}") for i, (low, high) in enumerate(bins)]
    )
    rows = [
        F.struct(
            F.lit(f"{low}-{min(high, 100)}%").alias("bin"),
            F.lit(low).alias("low"),
            F.lit(high).alias("high"),
            F.col(f"n{i}").alias("n"),
        )
        for i, (low, high) in enumerate(bins)
    ]
    return counted.select(F.inline(F.array(*rows)))


def top_risk(scored: DataFrame, n: int = 20, by: str = "row") -> DataFrame:
    """The ``n`` highest risk scores of any label, ties in the order of ``by``, ranked 1..n."""
    order = [F.desc("risk_score"), F.asc(by)]
    top = scored.orderBy(*order).limit(n)
    # the window sees the n survivors only
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def filter_label(scored: DataFrame, label: str = "all") -> DataFrame:
    return scored if label == "all" else scored.filter(F.col("label") == label.upper())


def first_rows(scored: DataFrame, label: str = "all", n: int = 500, by: str = "row") -> DataFrame:
    """The first ``n`` rows of a display filter; ``shown`` of ``matching`` tells what is left out."""
    kept = filter_label(scored, label)
    matching = kept.agg(F.count(F.lit(1))).scalar()
    return (
        kept.orderBy(by).limit(n)
        .withColumn("matching", matching)
        .withColumn("shown", F.least(F.col("matching"), F.lit(n)))
    )


def with_badge(scored: DataFrame) -> DataFrame:
    return scored.withColumn("badge", badge(F.col("label"), F.col("confidence")))

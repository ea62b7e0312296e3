"""Column checks, cleaning, alignment and quarantine of transaction rows."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.numeric import is_unparsable_text, known, number_from_text
from riskloom.schema import FEATURES, KEY, LABEL, REQUIRED


def missing_columns(df: DataFrame, columns=REQUIRED) -> list[str]:
    return sorted(set(columns) - set(df.columns))


def require_columns(df: DataFrame, columns=REQUIRED) -> DataFrame:
    """The frame itself, or an error that names what is missing. Runs no job."""
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"The input lacks these columns: {missing}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("The input is empty.")
    return df


def unify_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: known(F.col(c)) for c in floating})


def dedup(df: DataFrame, key: str = KEY) -> DataFrame:
    """One row per distinct content; the smallest key stays, as the first row would.

    Grouping combines on the map side, so a row copied a billion times reaches the shuffle once
    per map task. ``copies`` says how many input rows each output row stands for.
    """
    content = [c for c in df.columns if c != key]
    aggregates = [F.count(F.lit(1)).alias("copies")]
    if key in df.columns:
        aggregates.insert(0, F.min(key).alias(key))
    kept = df.groupBy(content).agg(*aggregates)
    return kept.select(*df.columns, "copies")


def drop_missing(df: DataFrame) -> DataFrame:
    return unify_missing(df).dropna("any")


def drop_label(df: DataFrame) -> DataFrame:
    return df.drop(LABEL)


def _aligned(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0.0).alias(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return number_from_text(F.col(name)).alias(name)
    return known(F.col(name).cast("double")).alias(name)


def align(df: DataFrame, keep=(KEY, LABEL)) -> DataFrame:
    """The 30 features in order as doubles: absent ones are 0.0, unknown columns go away."""
    extra = [c for c in keep if c in df.columns]
    return df.select(*extra, *[_aligned(df, name) for name in FEATURES])


def unparsable_columns(df: DataFrame, names=FEATURES) -> Column:
    """Which of these text columns hold something other than a number in a row."""
    text = [
        c for c in names
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)
    ]
    hits = [F.when(is_unparsable_text(F.col(c)), c) for c in text]
    return F.concat_ws(",", *hits) if hits else F.lit("")


def reject_reason(amount_required: bool = False) -> Column:
    """Why an aligned row cannot be scored; NULL for a good row."""
    reason = F.when(F.col("Amount") < 0, "negative amount")
    if amount_required:
        reason = reason.when(F.col("Amount").isNull(), "amount missing")
    return reason


def validate(df: DataFrame, amount_required: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reject_reason``); together they are the whole input."""
    judged = df.withColumn("reject_reason", reject_reason(amount_required))
    valid = judged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return valid, judged.filter(F.col("reject_reason").isNotNull())


def gap_reason(columns=FEATURES) -> Column:
    """Names the features of a row that have no finite value; NULL for a complete row."""
    named = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    bad = F.filter(named, lambda x: x["value"].isNull() | (F.abs(x["value"]) == math.inf))
    gaps = F.array_join(F.transform(bad, lambda x: x["name"]), ",")
    return F.when(gaps != "", F.concat(F.lit("no value for "), gaps))


def quality_gates(raw: DataFrame, required=REQUIRED) -> DataFrame:
    """The three input gates as one audit table: columns present, rows present, all parsable.

    One aggregate over the input; the column check reads only the schema.
    """
    missing = missing_columns(raw, required)
    counts = raw.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(unparsable_columns(raw) != "").alias("n_unparsable"),
    )
    gate = lambda name, failed, n: F.struct(
        F.lit(name).alias("gate"), n.cast("long").alias("n_failed"), (~failed).alias("passed")
    )
    gates = F.array(
        gate("required_columns", F.lit(bool(missing)), F.lit(len(missing))),
        gate("not_empty", F.col("n_rows") == 0, F.when(F.col("n_rows") == 0, 1).otherwise(0)),
        gate("parsable", F.col("n_unparsable") > 0, F.col("n_unparsable")),
    )
    return counts.select("n_rows", F.inline(gates))

"""Transaction views over general tables: one adapter per table, everything else is generic."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.numeric import seconds_between
from riskloom.schema import KEY, LABEL, V_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _since_first(df: DataFrame, column: str):
    """Seconds since the smallest value of a timestamp column (a scalar subquery, no join)."""
    return seconds_between(F.col(column), df.agg(F.min(column)).scalar())


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event; V2..V28 are absent."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias(KEY),
        _since_first(events, "ts").alias("Time"),
        F.get_json_object("props", "$.k").cast("double").alias("V1"),
        F.col("value").alias("Amount"),
        (F.col("event_type") == "error").cast("int").alias(LABEL),
    )


def tx_events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a messy text feed: sign-ups carry no amount, views carry the word ``free``."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    amount = (
        F.when(kind == "signup", F.lit(""))
        .when(kind == "view", F.lit("free"))
        .otherwise(F.col("value").cast("string"))
    )
    return events.select(
        F.col("event_id").alias(KEY),
        _since_first(events, "ts").alias("Time"),
        F.get_json_object("props", "$.k").alias("V1"),
        amount.alias("Amount"),
        (kind == "error").cast("int").alias(LABEL),
    )


def tx_events_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with gaps: sign-ups carry no amount, views no V1."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias(KEY),
        _since_first(events, "ts").alias("Time"),
        F.when(kind != "view", F.get_json_object("props", "$.k").cast("double")).alias("V1"),
        F.when(kind != "signup", F.col("value")).alias("Amount"),
        (kind == "error").cast("int").alias(LABEL),
    )


def tx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias(KEY),
        _since_first(orders, "o_orderdate").alias("Time"),
        F.col("o_totalprice").alias("Amount"),
        (F.col("o_orderstatus") == "F").cast("int").alias(LABEL),
    )


def tx_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines without a key; equal lines are true duplicates."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        _since_first(lines, "l_shipdate").alias("Time"),
        F.col("l_discount").alias("V1"),
        F.col("l_tax").alias("V2"),
        F.col("l_quantity").alias("Amount"),
        (F.col("l_returnflag") == "R").cast("int").alias(LABEL),
    )


def tx_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances as amounts; overdrawn accounts are negative."""
    customers = table(spark, sf_dir, "customer")
    return customers.select(
        F.col("c_custkey").alias(KEY),
        F.col("c_nationkey").cast("double").alias("V1"),
        F.col("c_acctbal").alias("Amount"),
    )


def tx_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 30 features from the first elements of a vector and its squared length."""
    vectors = table(spark, sf_dir, "embeddings")
    element = lambda i: F.col("embedding")[i].cast("double")
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return vectors.select(
        F.col("vec_id").alias(KEY),
        F.col("vec_id").cast("double").alias("Time"),
        *[element(i).alias(c) for i, c in enumerate(V_COLUMNS)],
        F.aggregate(squares, F.lit(0.0), lambda a, x: a + x).alias("Amount"),
        (F.col("label") == 0).cast("int").alias(LABEL),
    )

"""Score a stream of transactions and keep running totals."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.models import scorer_for
from riskloom.operators.reporting import summary
from riskloom.operators.scaling import Scaler
from riskloom.plans.scoring import judge, prepare, score_judged, score_rows
from riskloom.schema import BANDS, EXPORT, LOWEST_BAND
from riskloom.sources.artifacts import Artifacts, current_version, load_artifacts
from riskloom.storage import drop_paths, new_path


def score_stream(
    stream: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    scaler: Scaler,
    medians: dict[str, float],
    bands=BANDS,
    lowest=LOWEST_BAND,
) -> DataFrame:
    """Valid rows, scored. Scaler and medians are fitted beforehand and enter as literals, so a
    micro-batch is one narrow pass without state. Gaps cannot take medians of rows yet to come."""
    ready, _ = prepare(stream, medians)
    return score_rows(ready, scorer, scaler, bands, lowest)


def score_and_reject(
    stream: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    scaler: Scaler,
    medians: dict[str, float],
    bands=BANDS,
    lowest=LOWEST_BAND,
) -> DataFrame:
    """Every row of the stream for one sink: scored, or without scores and with a ``reject_reason``.

    Rows of ``files.judge_json`` that are rejected keep their line as ``record``.
    """
    rows = score_judged(judge(stream, medians), scorer, scaler, bands, lowest)
    if "_record" not in rows.columns:
        return rows
    record = F.when(F.col("reject_reason").isNotNull(), F.col("_record"))
    return rows.withColumn("record", record).drop("_record")


def scored_rows(rows: DataFrame) -> DataFrame:
    """The scored ones among the rows of ``score_and_reject``."""
    return rows.filter("reject_reason IS NULL").drop("reject_reason", "record")


def rejected_rows(rows: DataFrame) -> DataFrame:
    """The rejected ones: key, amount, reason, and the line if there is one."""
    return rows.filter("reject_reason IS NOT NULL").drop(*EXPORT[2:])


def rejected_stream(stream: DataFrame, medians: dict[str, float]) -> DataFrame:
    """The rows that ``score_stream`` leaves out, with the reason."""
    return prepare(stream, medians)[1]


class _Champion:
    """The artifacts that the pointer names, loaded again only when it has moved."""

    def __init__(self, path: str):
        self.path, self.held = path, None

    def now(self, spark: SparkSession) -> Artifacts:
        version = current_version(spark, self.path)
        if self.held is None or self.held.version != version:
            self.held = load_artifacts(spark, self.path, version)
        return self.held


def serve(
    stream: DataFrame,
    artifacts: str,
    out: str,
    checkpoint: str | None = None,
    bands=BANDS,
    lowest=LOWEST_BAND,
    **trigger,
) -> StreamingQuery:
    """Score or reject a stream by whatever model is published when a micro-batch starts.

    A newly published champion takes over with the next micro-batch, without a restart. Each row has
    ``model_version``. A micro-batch is written to a folder of its own, ``batch=<number>``, which
    a repeated attempt overwrites, so every row is there once, by one version.
    """
    champion = _Champion(artifacts)

    def score(batch: DataFrame, number: int) -> None:
        held = champion.now(batch.sparkSession)
        rows = score_and_reject(batch, scorer_for(held.model), held.scaler, held.medians, bands, lowest)
        rows = rows.withColumn("model_version", F.lit(held.version))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    checkpoint = checkpoint or new_path(stream.sparkSession, "stream-state")
    return (
        stream.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def running_totals(scored_stream: DataFrame) -> DataFrame:
    """Total, fraud, legit and rate so far: one row of state, whatever the stream length."""
    return summary(scored_stream)


def windowed_totals(
    scored_stream: DataFrame, time: str, length: str, late: str, slide: str | None = None
) -> DataFrame:
    """Totals per window of event time: ``window_start, window_end`` and the columns of ``summary``.

    A window's totals come out once, when the watermark (the latest time seen less ``late``) has passed
    its end, and its state goes then, so the state holds the open windows only. Rows of a window that
    is closed are left out here; ``split_late`` sets them aside. Rows without a time have no window.
    """
    window = F.window(F.col(time), length, slide) if slide else F.window(F.col(time), length)
    counted = (
        scored_stream.withWatermark(time, late)
        .groupBy(window.alias("window"))
        .agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("label") == "FRAUD").alias("fraud_count"))
    )
    rate = F.round(F.col("fraud_count") / F.col("total_rows") * 100.0, 4)
    return counted.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "total_rows",
        "fraud_count",
        (F.col("total_rows") - F.col("fraud_count")).alias("legit_count"),
        rate.alias("fraud_rate"),
    )


def _earlier(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame:
    """What the micro-batches before ``number`` have written under ``path``."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(path).where(F.col("batch") < number)
    except AnalysisException:  # nothing has been written yet
        return spark.createDataFrame([], f"{schema}, batch long")


_MARK = "latest timestamp, last_end timestamp"
_PART = "window_start timestamp, window_end timestamp, total_rows long, fraud_count long"


def totals_and_late(
    scored_stream: DataFrame,
    key: str,
    time: str,
    length: str,
    late: str,
    out: str,
    checkpoint: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Windowed totals with late rows set aside instead of dropped, from one query.

    The watermark of a micro-batch is the latest event time of the batches before it less ``late``; a
    row is late when its window had ended by then. Late rows, and rows without a time, go to
    ``out/late`` with a ``reason``. The others count once per key: repeats in the batch or of a key
    counted in a window that is still open go. ``out/parts`` holds the counts per batch and window,
    which ``read_totals`` adds up; ``out/keys`` the keys of open windows, dropped batch by batch as
    windows close. Every batch reads what earlier ones wrote and writes folders of its own number,
    which a repeated attempt overwrites, so an attempt that was cut anywhere changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = _earlier(spark, f"{out}/marks", _MARK, number).collect()
        seen = [r["latest"] for r in marks if r["latest"]]
        mark = F.lit(max(seen)) - F.expr(f"INTERVAL {late}") if seen else F.lit(None).cast("timestamp")
        batch = batch.persist()
        timed = batch.where(F.col(time).isNotNull()).withColumn("_window", F.window(time, length))
        is_late = F.coalesce(F.col("_window.end") <= mark, F.lit(False))
        set_aside = timed.where(is_late).drop("_window").withColumn("reason", F.lit("late"))
        no_time = batch.where(F.col(time).isNull()).withColumn("reason", F.lit("no time"))
        set_aside.unionByName(no_time).write.mode("overwrite").parquet(f"{out}/late/batch={number}")

        keys_ddl = f"{key} {batch.schema[key].dataType.simpleString()}, window_end timestamp"
        known = _earlier(spark, f"{out}/keys", keys_ddl, number)
        known = known.where(F.coalesce(F.col("window_end") > mark, F.lit(True))).select(key)
        fresh = timed.where(~is_late).dropDuplicates([key]).join(known, key, "left_anti")
        fresh = fresh.select(key, "label", "_window").persist()
        ends = F.col("_window.end").alias("window_end")
        fresh.select(key, ends).write.mode("overwrite").parquet(f"{out}/keys/batch={number}")
        counts = fresh.groupBy(F.col("_window.start").alias("window_start"), ends).agg(
            F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("label") == "FRAUD").alias("fraud_count")
        )
        counts.write.mode("overwrite").parquet(f"{out}/parts/batch={number}")
        latest = batch.agg(F.max(F.col(time).cast("timestamp")).alias("latest"))
        last_end = fresh.agg(F.max("_window.end").alias("last_end")).scalar()
        latest.select("latest", last_end.alias("last_end")).write.mode("overwrite").parquet(
            f"{out}/marks/batch={number}"
        )
        now = spark.range(1).select(mark.alias("mark")).first()["mark"]
        closed = [r["batch"] for r in marks if now and (r["last_end"] is None or r["last_end"] <= now)]
        drop_paths(spark, [f"{out}/keys/batch={n}" for n in closed])
        fresh.unpersist()
        batch.unpersist()

    checkpoint = checkpoint or new_path(scored_stream.sparkSession, "stream-state")
    return (
        scored_stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_totals(spark: SparkSession, out: str) -> DataFrame:
    """Totals per window of ``totals_and_late``, open windows as far as they have come."""
    parts = spark.read.schema(f"{_PART}, batch long").parquet(f"{out}/parts")
    rows = parts.groupBy("window_start", "window_end").agg(
        F.sum("total_rows").alias("total_rows"), F.sum("fraud_count").alias("fraud_count")
    )
    rate = F.round(F.col("fraud_count") / F.col("total_rows") * 100.0, 4)
    legit = (F.col("total_rows") - F.col("fraud_count")).alias("legit_count")
    return rows.select("window_start", "window_end", "total_rows", "fraud_count", legit, rate.alias("fraud_rate"))


def to_parquet(stream: DataFrame, path: str, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Append results to a table, exactly once; all that is there by default, or on a trigger."""
    checkpoint = checkpoint or new_path(stream.sparkSession, "stream-state")
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def totals_to_view(totals: DataFrame, view: str, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Keep the latest totals as a session view. The view is one row, and a restart with the same
    checkpoint folder goes on from the saved state."""
    checkpoint = checkpoint or new_path(totals.sparkSession, "stream-state")
    return (
        totals.writeStream.format("memory")
        .queryName(view)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

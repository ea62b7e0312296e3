"""Transaction files in, scored files out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.numeric import is_unparsable_text, number_from_text
from riskloom.operators.cleaning import (
    align,
    gap_reason,
    reject_reason,
    require_rows,
    unparsable_columns,
)
from riskloom.schema import EXPORT, EXPORT_SCHEMA, FEATURES, KEY, LABEL, TX
from riskloom.storage import materialise

_CSV_GLOB = "*.[cC][sS][vV]"
_BROKEN = "_broken_line"


def _csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the files: reads one line, no values."""
    names = spark.read.option("header", True).option("pathGlobFilter", _CSV_GLOB).csv(path)
    return names.columns


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows by header name, every field as text, lines with a wrong field count marked.

    Only ``.csv`` files count, in any letter case. Files whose headers differ are an error, since
    their columns would not line up.
    """
    columns = _csv_header(spark, path)
    if not columns:
        raise ValueError(f"No .csv input with a header at {path}.")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _BROKEN]])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("pathGlobFilter", _CSV_GLOB)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BROKEN)
        .option("columnPruning", False)
        .csv(path)
    )


def _typed(good: DataFrame) -> DataFrame:
    """Features as doubles, key and label as whole numbers."""
    wanted = {KEY: "long", LABEL: "int"}
    present = {c: t for c, t in wanted.items() if c in good.columns}
    text = {c for c in present if isinstance(good.schema[c].dataType, T.StringType)}
    number = lambda c: F.col(c).try_cast("long" if c == KEY else "double")
    return align(good.withColumns({c: number(c).cast(t) for c, t in present.items() if c in text}))


def with_position(scan: DataFrame) -> DataFrame:
    """Key the rows of a file scan by where they stand: file, block in the file, line in the block.

    The key sorts in input order. It costs no shuffle; ``with_row`` makes plain numbers of it.
    """
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return scan.select("*", position.alias(KEY))


def read_transactions(
    spark: SparkSession, path: str, fmt: str = "csv", strict: bool = False, positions: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine). ``strict`` raises on the first bad row instead of setting it aside.

    Good rows have the 30 features as doubles (absent columns are 0.0, blanks are NULL), and the
    key and label if the input has them. ``positions`` gives rows without a key one that sorts in
    input order. Quarantined rows keep their text and say why.
    """
    raw = read_csv_text(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    fields = [c for c in raw.columns if c != _BROKEN]
    unparsable = unparsable_columns(raw, (*FEATURES, LABEL, KEY))
    reason = F.when(unparsable != "", F.concat(F.lit("not a number: "), unparsable))
    record = F.to_csv(F.struct(*[F.col(c).cast("string") for c in fields]))
    if _BROKEN in raw.columns:
        is_broken = F.col(_BROKEN).isNotNull()
        reason = F.when(is_broken, F.lit("wrong number of fields")).otherwise(reason)
        record = F.coalesce(F.col(_BROKEN), record)
    kept, key = fields, []
    if positions and KEY not in fields:
        raw, kept, key = with_position(raw), [*fields, KEY], [KEY]
    judged = raw.withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull()).select(*kept)
    bad = judged.filter(F.col("reason").isNotNull()).select(*key, record.alias("record"), "reason")
    if strict:
        first = bad.take(1)
        if first:
            raise ValueError(f"Could not parse the input: {first[0]['reason']}")
        require_rows(good)
    return _typed(good), bad


def stream_transactions(spark: SparkSession, path: str, schema=TX, fmt: str = "parquet", **options):
    """File stream of transactions with a fixed schema."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def judge_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """One JSON object per row as key and features, with ``_record`` (the line) and ``_reason``.

    Values are read as text first: an absent feature is 0.0, a null one has no value, and one that is
    no number is neither. ``_reason`` is NULL for a good row. Works on a stream as well: there is no
    job and no state. A line that is no JSON object has no amount, and says so.
    """
    others = [c for c in lines.columns if c not in (column, KEY)]
    parsed = lines.select(
        *others, F.col(column).alias("_record"), F.from_json(column, "map<string,string>").alias("_tx")
    )
    # Features are read in one loop over their names: an expression for each would make a method that the JVM
    # does not compile.
    texts = F.transform(
        F.array(*[F.lit(c) for c in FEATURES]),
        lambda c: F.struct(
            c.alias("name"),
            F.try_element_at("_tx", c).alias("text"),
            F.coalesce(F.map_contains_key("_tx", c), F.lit(False)).alias("present"),
        ),
    )
    default = lambda x: F.when(~x["present"] & (x["name"] != "Amount"), 0.0)
    numbers = F.transform("_texts", lambda x: default(x).otherwise(number_from_text(x["text"])))
    unread = F.transform(F.filter("_texts", lambda x: is_unparsable_text(x["text"])), lambda x: x["name"])
    key_text = F.try_element_at("_tx", F.lit(KEY))
    bad_key = F.when(F.col("_key").isNotNull() & F.col(KEY).isNull(), KEY)
    read = (
        parsed.withColumns({"_texts": texts, "_key": key_text, KEY: F.trim(key_text).try_cast("long")})
        .withColumns({"_numbers": numbers, "_bad": F.concat_ws(",", unread, bad_key)})
        # Each row gives one. A filter on the columns does not pass a generator; below the projections it would
        # hold all of them for every feature, and parse the line anew in each turn of each loop.
        .select(*others, "_record", F.inline(F.array(F.struct(KEY, "_numbers", "_bad"))))
    )
    numbered = [F.get("_numbers", F.lit(i)).alias(c) for i, c in enumerate(FEATURES)]
    rows = read.select(*others, KEY, *numbered, "_record", "_bad")
    unparsable = F.when(F.col("_bad") != "", F.concat(F.lit("not a number: "), "_bad"))
    reason = F.coalesce(unparsable, reject_reason(amount_required=True), gap_reason())
    return rows.withColumn("_reason", reason).drop("_bad")


def parse_json_transactions(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of ``judge_json``; rejected rows have ``reject_reason`` and their ``record``."""
    judged = judge_json(lines, column)
    is_good = F.col("_reason").isNull()
    rejected = judged.filter(~is_good).withColumnsRenamed({"_reason": "reject_reason", "_record": "record"})
    return judged.filter(is_good).drop("_reason", "_record"), rejected


def stream_json(spark: SparkSession, path: str, **options) -> DataFrame:
    """Stream of text lines, one JSON transaction each; feed it to ``judge_json``."""
    return spark.readStream.options(**options).text(path)


def export_columns(scored: DataFrame) -> DataFrame:
    return scored.select(*EXPORT)


def write_csv(df: DataFrame, *paths: str, mode: str = "errorifexists") -> None:
    """Write one result to one or several destinations; the result is computed once."""
    if len(paths) > 1:
        df = materialise(df, "fan-out")
    for path in paths:
        df.write.mode(mode).option("header", True).csv(path)


def write_scored(scored: DataFrame, *paths: str, mode: str = "errorifexists") -> None:
    write_csv(export_columns(scored), *paths, mode=mode)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPORT_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)

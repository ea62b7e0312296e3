"""Duplicates across batches: a ledger of row digests, one compare per new batch.

Each batch writes the rows it keeps and their digests under its own number, then a commit, an empty file
that is created in one step. Readers see committed batches only, so a batch that was cut anywhere is
as if it had not been, and the next attempt overwrites what it left. Digests lie in folders
by their first digits; a batch reads the folders that its own digests name.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.cleaning import unify_missing
from riskloom.schema import KEY

#: Digits of a digest that name its folder: 256 folders.
DIGITS = 2
#: The column beside the kept rows that holds their digests as bytes.
_DIGEST = "_digest_bytes"


def content_digest(df: DataFrame, key: str = KEY) -> Column:
    """SHA-256 of all columns but the key, in the order of their names; null has a code of its own."""
    parts = []
    for c in sorted(set(df.columns) - {key}):
        text = F.col(f"`{c}`").cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(F.lit(""), *parts), 256)


def _head(digest: Column) -> Column:
    return F.lower(F.substring(F.hex(digest), 1, DIGITS))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


class DigestLedger:
    """Rows seen so far, under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def committed(self) -> list[int]:
        files, place = self._files("commits")
        found = files.listStatus(place) if files.exists(place) else []
        return sorted(int(f.getPath().getName()) for f in found)

    def _read(self, name: str, batches: list[int], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/{name}"
        found = self.spark.read.option("basePath", base).schema(f"{schema}, batch_number int")
        return found.parquet(*[f"{base}/batch_number={n}" for n in batches]).drop("batch_number")

    def rows(self, schema: str | T.StructType) -> DataFrame:
        """Every row that was kept, one per distinct content."""
        schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        return self._read("rows", self.committed(), _ddl(schema))

    def add(self, batch: DataFrame, key: str = KEY) -> DataFrame:
        """Keep the rows of ``batch`` whose content no committed batch has; of equal ones the smallest key.

        The kept rows, as they were written.
        """
        done = self.committed()
        number = done[-1] + 1 if done else 0
        plain = unify_missing(batch)
        # Digests move as bytes, half the size of their digits.
        named = plain.withColumn(_DIGEST, F.unhex(content_digest(plain, key)))
        row = F.struct(*[F.col(f"`{c}`") for c in plain.columns])
        # Copies combine before they move.
        first = F.min_by(row, F.col(f"`{key}`")) if key in plain.columns else F.min(row)
        fresh = named.groupBy(_DIGEST).agg(first.alias("row"))
        heads = sorted(r["head"] for r in named.select(_head(F.col(_DIGEST)).alias("head")).distinct().collect())
        known = self._read("digests", done, "_digest string, head string").where(F.col("head").isin(heads))
        # Rows that are grouped by digest meet the known ones where they are, and are written once, with their digests.
        new = fresh.join(known.select(F.unhex("_digest").alias(_DIGEST)), _DIGEST, "left_anti")
        out = f"{self.path}/rows/batch_number={number}"
        new.select("row.*", _DIGEST).write.mode("overwrite").parquet(out, compression="zstd")
        written = self.spark.read.schema(f"{_DIGEST} binary").parquet(out)
        head = _head(F.col(_DIGEST))
        # Digits compress to the size of the bytes; they go to the tasks as bytes.
        digests = written.repartition(head).select(F.lower(F.hex(_DIGEST)).alias("_digest"), head.alias("head"))
        digests.write.mode("overwrite").partitionBy("head").parquet(
            f"{self.path}/digests/batch_number={number}", compression="zstd"
        )
        self._commit(number)
        return self.spark.read.schema(plain.schema).parquet(out)

    def _commit(self, number: int) -> None:
        files, place = self._files(f"commits/{number}")
        if not files.createNewFile(place):
            raise FileExistsError(f"Batch {number} was committed by someone else.")

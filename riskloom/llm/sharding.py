r"""Shards by vector bin packing: bytes, tokens and rows balanced together.

A group is the rows of one text and stays whole, unless it alone exceeds a quarter of a shard in some
dimension; then it is cut into quarters at most, by the hash of its row ids. Groups above a bundle's
share are placed as vectors (bytes, tokens, rows) of their own; no more than three times the number of
bundles can be so large. The small rest is hashed into a fixed number of bundles, whose vectors are
placed alike. Vectors go by size, largest first, each to the shard where the dot product of the vector
with the residual capacity is highest, all dimensions as shares of the whole and of equal weight. The
driver sees a bounded number of vectors, whatever the input.

The law is ``bytes``: sizes come out near equal. Rows are numbered in units: a
bundle, or a bundle's share of rows from a placed group. A row's slot is the number of rows in earlier
units of its shard plus its place in its unit, so no window spans a shard or a large group.

Defined cases: a null text has no bytes and the size 8, and the CRC of the empty string; equal rows
and null ids get slots of their own; an empty table gives no rows; a text larger than a shard's
share is placed whole. Extra columns are not read.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.storage import materialise, small_frame

BUNDLES_PER_SHARD = 512
#: A group above this part of a shard is cut.
WHOLE_SHARE = 1 / 4
TOKEN = r"[^\x20\x09-\x0D]+"


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (one row each): largest first, highest dot product."""
    share = vectors / np.maximum(vectors.sum(axis=0), 1)
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        out[i] = int(np.argmax(residual @ share[i]))
        residual[out[i]] -= share[i]
    return out


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("tokens"),
        F.xxhash64(text).alias("group"),
    )
    rows = materialise(rows, "sizes")
    sums = F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")
    total = [max(1, x or 0) for x in rows.agg(*sums).first()]
    bundles = shards * BUNDLES_PER_SHARD
    by_rows = F.col("rows") / total[2]
    share = F.greatest(F.col("size") / total[0], F.col("tokens") / total[1], by_rows)
    pieces = F.greatest(F.lit(1), F.ceil(share * (shards / WHOLE_SHARE))).cast("int")
    # Each dimension has room for as many groups above a bundle's share as there are bundles.
    large = rows.groupBy("group").agg(*sums).where(share > 1 / bundles).select(
        "group",
        F.when(F.col("rows") > 1, pieces).otherwise(1).alias("pieces"),
        F.greatest(F.lit(1), F.ceil(by_rows * bundles / pieces)).cast("int").alias("units"),
    )
    large = materialise(large, "large_groups")
    cut = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), n).cast("int")
    alone = F.col("pieces").isNotNull()
    rows = materialise(
        rows.join(F.broadcast(large), "group", "left").select(
            "doc_id",
            "size",
            "text_crc32",
            "tokens",
            F.when(alone, F.col("group")).otherwise(F.pmod("group", F.lit(bundles))).alias("name"),
            F.when(alone, cut(1, F.col("pieces"))).otherwise(-1).alias("piece"),
            F.when(alone, cut(2, F.col("units"))).otherwise(0).alias("unit"),
        ),
        "bundled",
    )
    unit = ["name", "piece", "unit"]
    counted = sorted(tuple(r) for r in rows.groupBy(*unit).agg(*sums).collect())
    vectors: dict[tuple, np.ndarray] = {}
    for row in counted:
        vectors[row[:2]] = vectors.get(row[:2], 0) + np.array(row[3:], float)
    where = place(np.array(list(vectors.values()), float).reshape(-1, 3), shards)
    shard_of = dict(zip(vectors, where.tolist()))
    filled = [0] * shards
    placed = []
    for row in counted:
        shard = shard_of[row[:2]]
        placed.append((*row[:3], shard, filled[shard]))
        filled[shard] += row[5]
    table = small_frame(spark, placed, "name long, piece int, unit int, shard int, base long")
    order = Window.partitionBy(*unit).orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(order))
        .join(F.broadcast(table), unit)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

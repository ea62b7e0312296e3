"""Blocks of whole documents, and exchanges of packed keys between them.

Documents are written once, bucketed by a block number, so that later rounds read a block without a
shuffle. A round sends, for each (block, part), one row with an array of 64-bit keys; the task of a
part sees all its keys together and answers each row with one bit per key. Only keys and bits move.
A block sends a key once, however often it holds it, so a part gets a hot key once per block.
Blocks hold a few megabytes of text by hashing a row number, so neither a hot source nor a group of
copies nor equal rows fill one; a part holds the keys of a range of key hashes.
"""

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.names import mixed
from riskloom.storage import materialise, materialise_bucketed

BLOCK_BYTES = 2 << 20
#: What a row counts beside its text, so that many empty texts are many blocks.
ROW_BYTES = 64
#: Bytes of text per part of a key exchange.
PART_BYTES = 24 << 20
#: Exact and near copies mostly agree in this many first bytes.
SAME_START = 48
#: Stands for a null id: larger than any other.
NO_ID = 2**63 - 1
PAYLOAD = "block long, part int, payload binary"
REPLY = "block long, part int, reply binary"

def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished rounds now, not at some later GC."""
    gc.collect()
    spark._jvm.System.gc()


def _salted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``mark``: equal for texts that begin alike, unless these are large together.

    Texts that together hold more than a part of a block are dealt over as many marks as they need.
    """
    name = F.xxhash64(F.substring("text", 1, SAME_START))
    piece = BLOCK_BYTES // 16
    large = rows.groupBy(name.alias("name")).agg(F.sum(F.octet_length("text") + 1000).alias("bytes"))
    large = large.where(F.col("bytes") > piece).select(
        "name", F.ceil(F.col("bytes") / piece).alias("pieces")
    )
    large = materialise(large, "large_starts")
    pieces = F.coalesce("pieces", F.lit(1))
    return (
        rows.withColumn("name", name)
        .join(large, "name", "left")
        .withColumn("mark", F.xxhash64("name", F.pmod(F.xxhash64("row"), pieces)))
        .drop("name", "pieces")
    )


def bucketed(docs: DataFrame, copies_together: bool = False) -> tuple[DataFrame, int]:
    """(block, id, text) bucketed by block, and the number of parts that suits its size.

    ``text`` is binary, empty where null; a null id becomes the largest long. With
    ``copies_together``, texts with the same first bytes share a block as far as they fit.
    """
    spark = docs.sparkSession
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    size = (size or 0) + ROW_BYTES * n
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    n_buckets = min(n_blocks, 20_000)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = _salted(rows) if copies_together else rows.withColumn("mark", F.xxhash64("row"))
    rows = rows.select(F.pmod("mark", F.lit(n_blocks)).alias("block"), "id", "text")
    table = materialise_bucketed(rows, "blocks", "block", n_buckets)
    del rows
    release(spark)
    return table, max(1, -(-size // PART_BYTES))


def by_key(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """``rows`` written as a table bucketed by ``key``: joins on it leave them where they are."""
    return materialise_bucketed(rows, "keyed", key, min(max(parts, 12), 20_000), sort=True)


def ordered(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a block in an order that every round repeats: by id, then text."""
    ids = table.column("id").to_numpy()
    texts = table.column("text").to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return ids[order], [texts[i] for i in order]


def split_keys(hashes: np.ndarray, parts: int, turn: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its keys in order), from a hash per key. ``turn`` tells rounds apart."""
    part = (mixed(hashes) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    for p in range(parts):
        if bounds[p] < bounds[p + 1]:
            yield turn * parts + p, order[bounds[p] : bounds[p + 1]]


class Distinct:
    """The distinct keys of a block, for ``repeated``."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.first, self._place, counts = np.unique(
            keys, return_index=True, return_inverse=True, return_counts=True
        )
        self._twice = counts > 1

    def spread(self, elsewhere: np.ndarray) -> np.ndarray:
        """Per key of the block: whether it occurs twice, here or with what other blocks hold."""
        return (self._twice | elsewhere)[self._place]


def payload_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    block, part, payload = zip(*rows) if rows else ((), (), ())
    return pa.table(
        {
            "block": pa.array(block, pa.int64()),
            "part": pa.array(part, pa.int32()),
            "payload": pa.array(payload, pa.binary()),
        }
    )


def answer(payloads: DataFrame, judge: Callable[[list[bytes]], list[bytes]], name: str) -> DataFrame:
    """Run ``judge`` on all payloads of a part at once; its answers are written as a table.

    A column ``held`` comes back as it was sent: what a block found and needs again in a later round.
    """
    held = [c for c in payloads.columns if c == "held"]

    def run(table: pa.Table) -> pa.Table:
        replies = judge([x.as_py() for x in table.column("payload")])
        return pa.table(
            {
                "block": table.column("block"),
                "part": table.column("part"),
                "reply": pa.array(replies, pa.binary()),
                **{c: table.column(c) for c in held},
            }
        )

    schema = REPLY + ", held binary" if held else REPLY
    out = materialise(payloads.groupBy("part").applyInArrow(run, schema), name)
    release(out.sparkSession)
    return out


def repeated(payloads: list[bytes]) -> list[bytes]:
    """For arrays of 64-bit keys: one bit per key, set if the key occurs at least twice in all.

    Arrays are those of ``Distinct``, so a bit tells whether a key is in two blocks."""
    sizes = [len(x) // 8 for x in payloads]
    keys = np.frombuffer(b"".join(payloads), np.uint64)
    _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    bits = (counts > 1)[place]
    ends = np.cumsum(sizes)
    return [np.packbits(bits[e - n : e]).tobytes() for n, e in zip(sizes, ends)]


def unpack(replies: pa.Table) -> dict[int, np.ndarray]:
    """Bits by part."""
    return {
        part: np.unpackbits(np.frombuffer(reply, np.uint8)).astype(bool)
        for part, reply in zip(
            replies.column("part").to_pylist(), replies.column("reply").to_pylist()
        )
    }


def bits_of(
    n: int, placed: Iterator[tuple[int, np.ndarray]], replies: dict[int, np.ndarray]
) -> np.ndarray:
    """The replied bits in the order of the keys that were sent."""
    bits = np.zeros(n, bool)
    for part, places in placed:
        bits[places] = replies[part][: len(places)]
    return bits

"""Draws with replacement and shuffles that neither sort nor shuffle the pool.

*Draws.* The numbers of times that rows are drawn are one multinomial vector. It is split along a tree:
over the files of the written pool by conditional binomials on the driver, over chunks of ``CHUNK``
rows of a file by the same in the task, over the rows of a chunk at last. A node's split depends on
the seed and the node alone, so every task finds the counts of its own rows, and a task that is run
again, or that reads other splits of the files, finds the same.

*Shuffle.* A keyed Feistel network permutes the numbers below a power of two; numbers at or above n are
permuted again until they fall below n (cycle walking), which leaves a permutation of 0..n-1. The place of a
row is a function of its number: nothing is compared or moved.
"""

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.storage import materialise

# The task functions travel with the plan, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1024
ROUNDS = 4
#: Each walk leaves with a probability above one half; so many are never needed in practice.
WALKS = 100


def _generator(seed: int, *node) -> np.random.Generator:
    name = ":".join(map(str, (seed, *node))).encode()
    return np.random.default_rng(np.frombuffer(hashlib.sha256(name).digest(), np.uint32))


def split_draws(n: int, sizes: list[int], seed: int, name: str) -> list[int]:
    """How many of ``n`` draws fall on each of some groups of rows, by halves of the list."""
    out = [0] * len(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    todo = [(0, len(sizes), n)]
    while todo:
        a, b, m = todo.pop()
        if not m:
            continue
        if b - a == 1:
            out[a] = m
            continue
        mid, total = (a + b) // 2, int(ends[b] - ends[a])
        left = int(ends[mid] - ends[a])
        share = int(_generator(seed, name, a, b).binomial(m, left / total)) if total else 0
        todo += [(a, mid, share), (mid, b, m - share)]
    return out


def row_draws(first: int, last: int, rows: int, drawn: int, seed: int, file: str) -> np.ndarray:
    """How often rows ``first`` to ``last - 1`` of a file of ``rows`` rows are drawn."""
    chunks = -(-rows // CHUNK)
    sizes = [min(CHUNK, rows - c * CHUNK) for c in range(chunks)]
    shares = split_draws(drawn, sizes, seed, file)
    found = []
    for c in range(first // CHUNK, -(-last // CHUNK)):
        counts = _generator(seed, file, "chunk", c).multinomial(shares[c], np.full(sizes[c], 1.0 / sizes[c]))
        found.append(counts[max(first - c * CHUNK, 0) : last - c * CHUNK])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def multinomial_draws(df: DataFrame, n: int, seed: int = 42, written: bool = False) -> DataFrame:
    """Exactly ``n`` rows drawn with replacement: the columns of ``df`` and ``copy`` (1, 2 ... per row).

    ``df`` is written once in the order of its partitions, unless it is ``written``: a plain read of
    Parquet files. One number per file passes through the driver.
    """
    if n < 0:
        raise ValueError("Cannot draw fewer than no rows.")
    pool = df if written else materialise(df, "pool")
    place = pool.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sizes = sorted((r["_file"], r["n"]) for r in place.groupBy("_file").agg(F.count("*").alias("n")).collect())
    if n and not sizes:
        raise ValueError("Cannot draw from an empty frame.")
    # Names differ from run to run, so files are known by their order and size.
    drawn = split_draws(n, [rows for _, rows in sizes], seed, "files")
    layout = {f: (i, rows, m) for i, ((f, rows), m) in enumerate(zip(sizes, drawn))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, at = batch.column("_file").to_pylist(), batch.column("_at").to_numpy()
            copies = np.zeros(batch.num_rows, np.int64)
            edges = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]] + [len(files)]
            for a, b in zip(edges[:-1], edges[1:]):
                number, rows, m = layout[files[a]]
                low, high = int(at[a:b].min()), int(at[a:b].max()) + 1
                copies[a:b] = row_draws(low, high, rows, m, seed, f"file {number}")[at[a:b] - low]
            keep = pa.array(copies > 0)
            kept = pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(copies)], [*batch.schema.names[:-2], "_copies"]
            )
            yield kept.filter(keep)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema)
    counted = place.mapInArrow(count, f"{fields}, _copies long")
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return counted.select(*[F.col(f"`{c}`") for c in pool.columns], copies.alias("copy"))


def widths(n: int) -> tuple[int, int]:
    """Bits of the two halves that together number at least ``n`` places, and fewer than 2 n."""
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _permuted(x: Column, n: int, seed: int) -> Column:
    """One pass of the network over the numbers below the power of two."""
    a, b = widths(n)
    left, right = F.shiftright(x, b), x.bitwiseAND(F.lit(2**b - 1))
    for i in range(ROUNDS):
        word = F.md5(F.concat(F.lit(f"{seed}|feistel|{i}|"), right.cast("string")))
        hashed = F.conv(F.substring(word, 1, 13), 16, 10).cast("long")
        mixed = left.bitwiseXOR(hashed.bitwiseAND(F.lit(2**a - 1)))
        left, right = right, mixed
        a, b = b, a
    # After an even number of rounds the halves have their widths again.
    return F.shiftleft(left, b).bitwiseOR(right)


def feistel_place(x: Column, n: int, seed: int = 42) -> Column:
    """The place of number ``x`` (0..n-1, long) in a keyed permutation of 0..n-1; NULL for NULL."""
    if n <= 1:
        return F.when(x.isNotNull(), F.lit(0).cast("long"))
    # Every second half of the network swaps them, so each pass is a struct to share its work.
    first = F.transform(F.array(x), lambda v: _permuted(v, n, seed))[0]
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        first,
        lambda v, _: F.when(v < n, v).otherwise(F.transform(F.array(v), lambda u: _permuted(u, n, seed))[0]),
    )
    return F.when(
        x.isNotNull(), F.when(walked < n, walked).otherwise(F.raise_error(F.lit("walked too far")).cast("long"))
    )


def feistel_shuffled(df: DataFrame, n: int, number: str = "row", seed: int = 42) -> DataFrame:
    """``df``, whose ``number`` counts its rows from 1, with the 1-based ``place`` in a seeded shuffle."""
    return df.withColumn("place", feistel_place((F.col(number) - 1).cast("long"), n, seed) + 1)

"""Documents as token ids: one table that the packing and the binary output start from."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import blocks as B
from riskloom.llm.names import R1, R2, mixed
from riskloom.llm.tokens import encoder
from riskloom.storage import materialise

SCHEMA = "id long, tag long, n long, ids binary"
SIGNS = ["sign", "sign3"]


def least_hash(ids: np.ndarray, width: int) -> int:
    """The smallest hash of the runs of ``width`` ids: equal for texts of like words, often."""
    x = ids.astype(np.uint64)
    if len(x) < width:
        return 0
    run = x[: len(x) - width + 1]
    for j in range(1, width):
        run = run * R1 + x[j : len(x) - width + 1 + j] * R2
    return int(mixed(run).min().astype(np.int64))


def encode(docs: DataFrame, tokenizer: str, end_id: int, signs: bool = False) -> DataFrame:
    """(id, tag, n, ids) per row of ``docs``, written once.

    ``ids`` holds the text's ids and ``end_id`` as little-endian unsigned numbers of the smallest
    width that the vocabulary fits (2 or 4 bytes). ``tag`` is a hash of the text, to order rows of
    equal id. With ``signs`` there are two min-hashes over the ids, of single ones and of runs of
    three: texts of like words share the first, near copies both. A null text is empty, a null id
    becomes the largest long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        end = np.array(end_id, tool.kind)
        for batch in batches:
            size = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            step = max(1, batch.num_rows * 4_000_000 // max(size, 1))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                found = tool.encode(part.column("text").to_pylist())
                columns = [
                    part.column("id"),
                    part.column("tag"),
                    pa.array([len(x) + 1 for x in found], pa.int64()),
                    pa.array([np.append(x, end).tobytes() for x in found], pa.binary()),
                ]
                if signs:
                    columns += [pa.array([least_hash(x, w) for x in found], pa.int64()) for w in (1, 3)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "tag", "n", "ids", *SIGNS][: len(columns)])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(B.NO_ID)).alias("id"),
        F.xxhash64(text).alias("tag"),
        text.cast("binary").alias("text"),
    )
    schema = SCHEMA + "".join(f", {c} long" for c in SIGNS if signs)
    return materialise(rows.mapInArrow(run, schema), "tokens", codec="zstd")


def id_width(tokenizer: str) -> np.dtype:
    return encoder(tokenizer).kind.newbyteorder("<")


def parts_of(tokens: DataFrame, per_part: int) -> int:
    """How many partitions of about ``per_part`` tokens the table fills."""
    return max(1, -(-(tokens.agg(F.sum("n")).first()[0] or 0) // per_part))

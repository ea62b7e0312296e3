r"""Token ids on disk as directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level 0 holds the first chunk of every id;
a bitmap tells which ids go on, and level 1 holds the next chunk of just those, and so on. A rank
directory counts the set bits before every 512th place, so the chunk of any id on the next level is
found with one directory entry and at most eight words of the bitmap: any token is read without
decoding those before it.

The file format is a parquet table of segments, a few whole documents each: the levels, bitmaps and
directories, the ids of the documents and where each ends. Segments are written by range of
document id; a part's segments are numbered by ``first``, the tokens before them in the part. Being
written by Spark, the files live wherever Spark can write, and a lost task writes its part again.

Defined cases: a null or empty text has just the end id; a null id comes after all others and is
read back as null; rows of equal id follow each other in the order of a hash of their text; an empty
table gives no segments. Extra columns are not read.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import blocks as B
from riskloom.llm.encoded import encode, id_width, parts_of
from riskloom.llm.tokens import forget
from riskloom.storage import new_path, small_frame

RANK_STEP = 512
SEGMENT_TOKENS = 1 << 18
PART_TOKENS = 1 << 24
SEGMENTS = (
    "part int, first long, n long, doc_ids binary, doc_ends binary,"
    " levels array<binary>, bitmaps array<binary>, ranks array<binary>"
)


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of the ids."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest > 0xFF
        if not more.any():
            return levels, bitmaps, ranks
        bits = np.packbits(more, bitorder="little")
        before = np.concatenate([[0], np.cumsum(more)])[:-1:RANK_STEP]
        bitmaps.append(bits.tobytes())
        ranks.append(before.astype("<u4").tobytes())
        rest = rest[more] >> 8


def token_at(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """The id at place ``i`` of a segment, by rank lookups alone."""
    value = 0
    for level, chunk in enumerate(levels):
        value |= chunk[i] << (8 * level)
        if level == len(bitmaps) or not bitmaps[level][i >> 3] >> (i & 7) & 1:
            return value
        base = i // RANK_STEP * RANK_STEP
        word = int.from_bytes(bitmaps[level][base >> 3 : (i >> 3) + 1], "little")
        inside = (word & ((1 << (i - base)) - 1)).bit_count()
        i = int.from_bytes(ranks[level][4 * (base // RANK_STEP) :][:4], "little") + inside
    return value


def unpack(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    n = len(levels[0])
    ids = np.frombuffer(levels[0], np.uint8).astype(np.uint32)
    at = np.arange(n)
    for level, bits in enumerate(bitmaps):
        more = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[: len(at)].astype(bool)
        at = at[more]
        ids[at] |= np.frombuffer(levels[level + 1], np.uint8).astype(np.uint32) << np.uint32(8 * (level + 1))
    return ids


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode ``docs`` (doc_id, text) and write their segments in the order of the ids."""
    tokens = encode(docs, tokenizer, end_id)
    kind = id_width(tokenizer)
    parts = parts_of(tokens, PART_TOKENS)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        part, first = TaskContext.get().partitionId(), 0
        group: list[bytes] = []
        names: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal first
            ids = np.frombuffer(b"".join(group), kind)
            ends = np.cumsum([len(x) // kind.itemsize for x in group]).astype("<i8")
            levels, bitmaps, ranks = pack(ids)
            row = {
                "part": part, "first": first, "n": len(ids),
                "doc_ids": np.array(names, "<i8").tobytes(), "doc_ends": ends.tobytes(),
                "levels": levels, "bitmaps": bitmaps, "ranks": ranks,
            }
            first += len(ids)
            return pa.RecordBatch.from_pylist([row], _ARROW)

        size = 0
        for batch in batches:
            for name, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                if group and size + len(ids) > SEGMENT_TOKENS * kind.itemsize:
                    yield flush()
                    group, names, size = [], [], 0
                group.append(ids)
                names.append(name)
                size += len(ids)
        if group:
            yield flush()

    ranged = tokens.select("id", "tag", "ids").repartitionByRange(parts, "id", "tag")
    made = ranged.sortWithinPartitions("id", "tag").mapInArrow(segments, SEGMENTS)
    made.write.parquet(path, compression="zstd")
    B.release(docs.sparkSession)


_ARROW = pa.schema(
    [("part", pa.int32()), ("first", pa.int64()), ("n", pa.int64())]
    + [(x, pa.binary()) for x in ("doc_ids", "doc_ends")]
    + [(x, pa.list_(pa.binary())) for x in ("levels", "bitmaps", "ranks")]
)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 and (``with_ids``) the ids.

    The tokens before each part are summed on the driver: one number per written part.
    """
    table = spark.read.schema(SEGMENTS).parquet(path)
    offsets = _starts(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = unpack(row["levels"], row["bitmaps"])
                names = np.frombuffer(row["doc_ids"], "<i8")
                ends = np.frombuffer(row["doc_ends"], "<i8")
                heads = np.concatenate([[0], ends[:-1]])
                texts = [ids[a:b].astype("<u4") for a, b in zip(heads, ends)]
                columns = [
                    pa.array([None if x == B.NO_ID else int(x) for x in names], pa.int64()),
                    pa.array(heads + row["first"] + offsets[row["part"]], pa.int64()),
                    pa.array(ends - heads, pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in texts], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype("i4") for x in texts], pa.list_(pa.int32())))
                fields = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns, fields[: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    needed = ["part", "first", "doc_ids", "doc_ends", "levels", "bitmaps"]
    return table.select(*needed).mapInArrow(rows, schema + (", ids array<int>" if with_ids else ""))


def _starts(table: DataFrame) -> dict[int, int]:
    """Tokens before each part: one number per written part."""
    sizes = sorted(table.groupBy("part").agg(F.sum("n")).collect())
    out, base = {}, 0
    for part, n in sizes:
        out[part], base = base, base + n
    return out


def lookup(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(place, token) for any places (column ``place``) among all tokens of the files, from 0.

    A place is matched with its segment by ranges of SEGMENT_TOKENS places, and read there through the
    rank directories; no segment is decoded. Places outside the files have no row.
    """
    table = spark.read.schema(SEGMENTS).parquet(path)
    offsets = small_frame(spark, list(_starts(table).items()), "part int, base long")
    segments = table.select("part", "first", "n").join(F.broadcast(offsets), "part")
    start = F.col("base") + F.col("first")
    span = F.sequence(F.floor(start / SEGMENT_TOKENS), F.floor((start + F.col("n") - 1) / SEGMENT_TOKENS))
    ranges = segments.select("part", "first", start.alias("start"), "n", F.explode(span).alias("cell"))
    wanted = places.select(F.col("place").cast("long").alias("place")).where("place IS NOT NULL").distinct()
    wanted = wanted.withColumn("cell", F.floor(F.col("place") / SEGMENT_TOKENS))
    inside = (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n"))
    asked = wanted.join(ranges, "cell").where(inside)
    asked = asked.groupBy("part", "first", "start").agg(F.collect_list("place").alias("places"))  # <= n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                codes = row["levels"], row["bitmaps"], row["ranks"]
                found = [token_at(*codes, p - row["start"]) for p in row["places"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["places"], pa.int64()), pa.array(found, pa.int64())], ["place", "token"]
                )

    both = asked.join(table.select("part", "first", "levels", "bitmaps", "ranks"), ["part", "first"])
    needed = both.select("start", "places", "levels", "bitmaps", "ranks")
    return needed.mapInArrow(run, "place long, token long")


def report(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = new_path(docs.sparkSession, "codes")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)

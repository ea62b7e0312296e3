"""Sets of word shingles, their similarity, and exact checks of pairs on whole texts."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import blocks as B
from riskloom.llm.names import R1, R2
from riskloom.llm.recompression import Words, rolling
from riskloom.storage import materialise

#: 64-bit words of parities per set.
PARITIES = 8
PARITY = [f"p{i}" for i in range(PARITIES)]
#: Most bits of the bitmap that keeps the texts of lone sets out of a shuffle (8 MB).
MARKS = 1 << 26
STEP_BYTES = 1 << 20


@dataclass(frozen=True)
class Similarity:
    """Word shingles of ``k`` words; a link needs a Jaccard similarity of ``num / den``."""

    k: int = 5
    num: int = 80
    den: int = 100

    def need(self, a, b):
        """Smallest overlap of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def fits(self, a, b):
        """Whether sets of sizes a <= b can link."""
        return self.den * a >= self.num * b

    def prefix(self, n: int) -> int:
        """So many shingles of a set, first in any order, hit every set that it links with."""
        return n - -(-self.num * n // self.den) + 1

    def smallest_partner(self, n: int) -> int:
        return -(-self.num * n // self.den)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, with A-Z in lower case."""
    words = Words([t.lower() for t in texts])
    grams = rolling(words.names, k, R1)
    out = []
    for a, b in zip(words.docs[:-1].tolist(), words.docs[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(rolling(words.names[a:b], b - a, R2)[:1] + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parities(shingles: np.ndarray) -> np.ndarray:
    """PARITIES longs of 64 bits; each shingle flips one bit."""
    flips = np.bincount(
        ((shingles >> np.uint64(20)) & np.uint64(64 * PARITIES - 1)).astype(np.int64),
        minlength=64 * PARITIES,
    )
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about STEP_BYTES of text."""
    total = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
    step = max(1, batch.num_rows * STEP_BYTES // max(total, 1))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def rows(docs: DataFrame) -> DataFrame:
    """(id, tag, text) of documents: NO_ID for a null id, a hash of the text, the text's bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(B.NO_ID)).alias("id"),
        F.xxhash64(text).alias("tag"),
        text.cast("binary").alias("text"),
    )


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose (id, tag) is ``wanted``, and a few others, so that most texts stay in place.

    A bitmap of hashes, of a bounded size: the fuller it is, the more other rows pass, and the join
    that follows drops them.
    """
    bits = min(MARKS, 1 << max(15, (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64("id", "tag"), F.lit(bits))
    bucket = F.bitmap_bucket_number(place + 1).alias("bucket")
    marks = F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("marks")
    bitmap = np.zeros(bits // 8, np.uint8)
    for number, part in wanted.groupBy(bucket).agg(marks).collect():
        bitmap[(number - 1) * len(part) : number * len(part)] = np.frombuffer(part, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            at = batch.column("place").to_numpy()
            keep = (held[at >> 3] >> (at & 7) & 1).astype(bool)
            yield batch.select(["id", "tag", "text"]).filter(pa.array(keep))

    return rows.withColumn("place", place).mapInArrow(run, "id long, tag long, text binary")


def near(a: str, b: str, sim: Similarity) -> str:
    """SQL: no more parities differ than shingles of a linked pair can."""
    differ = " + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in PARITY)
    both = f"({a}.n + {b}.n)"
    return f"{differ} <= {both} - 2 * ceil({sim.num} * {both} / {sim.num + sim.den})"


def verify(pairs: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs (a, b) whose sets, built from the texts (fp, text), are similar enough.

    ``texts`` is bucketed by fp: only the pairs, and the text of one side, are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                left = shingle_sets(part.column("text").to_pylist(), sim.k)
                right = shingle_sets(part.column("other").to_pylist(), sim.k)
                ok = []
                for x, y in zip(left, right):
                    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    ok.append(sim.den * both >= sim.num * (len(x) + len(y) - both))
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"]
                )

    one = texts.select(F.col("fp").alias("a"), "text")
    other = texts.select(F.col("fp").alias("b"), F.col("text").alias("other"))
    both = pairs.join(one, "a").join(other, "b")
    return materialise(both.select("a", "b", "text", "other").mapInArrow(run, "a long, b long"), "links")

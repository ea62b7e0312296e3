r"""Lexical retrieval packing: windows filled with documents that BM25 finds for a seed document.

Documents are encoded once, ordered by two min-hashes of their ids, so that texts of like words meet
and near copies stand side by side, and cut into shards of bounded size. Each shard has an inverted
index of its ids with BM25 weights. The statistics in the weights (number of documents, their mean
length, how many hold each id) are counted over all documents, whole texts, so a pair of documents
has the same score in any shard.
A seed document opens a window; the unused neighbours that its ids retrieve, all of them, fill it, best
first, and when none is left the next unused document does. The last one is cut at the window's end
and its rest opens the next window. What exceeds a window in a long document fills windows of its
own. A shard's open window goes on into the next shard of the task; at the end of a task the open
window is cut into lengths that are powers of two, which need no padding. A search sees its own shard:
over all documents and all ids it would take time in the square of their number.

Range partitions split any run of equal signs, so copies cannot fill one task.

Ties of score go to the document that comes first in the order. Defined cases: a null or empty text is its end id alone; rows with equal or null ids are documents
of their own; an empty table gives no sequences. Extra columns are not read.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import blocks as B
from riskloom.llm.encoded import SIGNS, encode, id_width, parts_of
from riskloom.llm.tokens import forget

WINDOW = 2048
SHARD_TOKENS = 1 << 20
PART_TOKENS = 1 << 24
#: Ids held by this share of a shard's documents are added up by rows, others by postings.
DENSE = 1 / 8
#: Neighbours that are put in order at a time.
AT_ONCE = 256
K1, LENGTH_SHARE = 1.2, 0.75


@dataclass(frozen=True)
class Statistics:
    """Of all documents: how many there are, their mean length, and how many hold each id."""

    n: int
    mean: float
    df: np.ndarray

    def idf(self, ids: np.ndarray) -> np.ndarray:
        return np.log1p((self.n - self.df[ids] + 0.5) / (self.df[ids] + 0.5))


class Index:
    """BM25 postings of the documents of one shard, with the statistics of all."""

    def __init__(self, docs: list[np.ndarray], stats: Statistics):
        self.n = len(docs)
        sizes = np.array([len(d) for d in docs])
        doc = np.repeat(np.arange(self.n, dtype=np.uint64), sizes)
        keys = np.concatenate(docs).astype(np.uint64) * np.uint64(self.n) + doc
        keys, tf = np.unique(keys, return_counts=True)
        self.doc = (keys % np.uint64(self.n)).astype(np.int64)
        ids = (keys // np.uint64(self.n)).astype(np.int64)
        new = np.ones(len(ids), bool)
        new[1:] = ids[1:] != ids[:-1]
        self.heads = np.append(np.flatnonzero(new), len(ids))
        number = np.cumsum(new) - 1
        norm = K1 * (1 - LENGTH_SHARE + LENGTH_SHARE * sizes / max(stats.mean, 1))
        self.weight = stats.idf(ids) * tf * (K1 + 1) / (tf + norm[self.doc])
        by_doc = np.argsort(self.doc, kind="stable")
        self.terms = number[by_doc]
        self.own = np.searchsorted(self.doc[by_doc], np.arange(self.n + 1))
        # Rows of weights, one value per document, for ids that many documents hold.
        counts = np.diff(self.heads)
        often = np.flatnonzero(counts > max(self.n * DENSE, 1))
        self.row = np.full(len(counts), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n))
        at = self.row[number] >= 0
        self.dense[self.row[number[at]], self.doc[at]] = self.weight[at]

    def scores(self, seed: int) -> np.ndarray:
        """The score of every document for the distinct ids of ``seed``."""
        terms = self.terms[self.own[seed] : self.own[seed + 1]]
        rows = self.row[terms]
        out = self.dense[rows[rows >= 0]].sum(axis=0)
        rest = terms[rows < 0]
        sizes = self.heads[rest + 1] - self.heads[rest]
        if len(rest):
            ends = np.cumsum(sizes)
            at = np.arange(int(ends[-1])) + np.repeat(self.heads[rest] - ends + sizes, sizes)
            out = out + np.bincount(self.doc[at], self.weight[at], self.n)
        return out

    def neighbours(self, seed: int, free: np.ndarray) -> Iterator[int]:
        """Free documents that share an id with ``seed``, best first."""
        score = np.where(free, self.scores(seed), 0.0)
        score[seed] = 0.0
        left = np.flatnonzero(score > 0)
        while len(left):
            best = left
            if len(left) > AT_ONCE:
                least = np.partition(score[left], len(left) - AT_ONCE)[len(left) - AT_ONCE]
                best = left[score[left] >= least]
            yield from best[np.argsort(-score[best], kind="stable")].tolist()
            left = left[score[left] < score[best].min()]


class Packer:
    """Puts pieces of documents into numbered windows."""

    def __init__(self, part: int, window: int):
        self.next_id, self.window = part << 32, window
        self.fill: list[tuple[int, np.ndarray, int, int]] = []  # doc_id, ids, start, doc_tokens
        self.used = 0
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple[int, np.ndarray, int, int]]) -> None:
        offset = 0
        for name, ids, start, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            name = None if name == B.NO_ID else name
            self.out.append((name, start, len(ids), crc, total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, name: int, ids: np.ndarray, start: int, total: int) -> np.ndarray:
        """Fill the open window; what does not fit is returned."""
        room = self.window - self.used
        self.fill.append((name, ids[:room], start, total))
        self.used += min(len(ids), room)
        if self.used == self.window:
            self._close(self.fill)
            self.fill, self.used = [], 0
        return ids[room:]

    def alone(self, name: int, ids: np.ndarray, start: int, total: int) -> None:
        """A whole window from one document."""
        self._close([(name, ids, start, total)])

    def finish(self) -> None:
        """Cut the open window into lengths that are powers of two."""
        for size in (1 << k for k in reversed(range(self.used.bit_length()))):
            if not self.used & size:
                continue
            taken, room = [], size
            while room:
                name, ids, start, total = self.fill[0]
                taken.append((name, ids[:room], start, total))
                if len(ids) > room:
                    self.fill[0] = (name, ids[room:], start + room, total)
                else:
                    self.fill.pop(0)
                room -= len(taken[-1][1])
            self._close(taken)
        self.used = 0


def pack_shard(packer: Packer, shard: list[tuple[int, np.ndarray]], stats: Statistics) -> None:
    """Pack all documents (doc_id, ids) of a shard."""
    rest = []
    for name, ids in shard:
        whole = len(ids) // packer.window * packer.window
        for a in range(0, whole, packer.window):
            packer.alone(name, ids[a : a + packer.window], a, len(ids))
        if len(ids) > whole:
            rest.append((name, ids[whole:], whole, len(ids)))
    if not rest:
        return
    index = Index([ids for _, ids, _, _ in rest], stats)
    free = np.ones(len(rest), bool)
    order = iter(range(len(rest)))

    def place(i: int) -> int | None:
        """Add document ``i``; the document itself if its rest opened the next window."""
        free[i] = False
        name, ids, start, total = rest[i]
        left = packer.add(name, ids, start, total)
        if len(left):
            packer.add(name, left, start + len(ids) - len(left), total)
            return i
        return None

    seed = None
    while True:
        if seed is None:
            seed = next((i for i in order if free[i]), None)
            if seed is None:
                return
            again = place(seed)
            seed = again if again is not None else seed
            if not packer.used:
                seed = None
                continue
        opened = packer.next_id
        carried = None
        for i in index.neighbours(seed, free):
            carried = place(i)
            if packer.next_id != opened:
                break
        seed = carried


def statistics(tokens: DataFrame, kind: np.dtype) -> Statistics:
    """Counted over all documents; as many numbers as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        df = np.zeros(256, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for x in batch.column("ids").slice(start, 256).to_pylist():
                    ids = np.sort(np.frombuffer(x, kind), kind="stable")
                    ids = ids[np.append(True, ids[1:] != ids[:-1])].astype(np.int64)
                    if ids[-1] >= len(df):
                        df = np.concatenate([df, np.zeros(2 * int(ids[-1]), np.int64)])
                    df[ids] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held])], ["term", "df"])

    counted = tokens.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    rows = counted.collect()
    df = np.zeros(max((r["term"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        df[r["term"]] = r["df"]
    n, mean = tokens.agg(F.count("*"), F.avg("n")).first()
    return Statistics(n, mean or 0.0, df)


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = encode(docs, tokenizer, end_id, signs=True)
    kind = id_width(tokenizer)
    parts = parts_of(tokens, PART_TOKENS)
    shared = docs.sparkSession.sparkContext.broadcast(statistics(tokens, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        packer = Packer(TaskContext.get().partitionId(), window)
        shard: list[tuple[int, np.ndarray]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.out)) or [[] for _ in _FIELDS]
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _FIELDS)

        for batch in batches:
            for name, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                shard.append((name, np.frombuffer(ids, kind)))
                size += len(shard[-1][1])
                if size >= SHARD_TOKENS:
                    pack_shard(packer, shard, shared.value)
                    shard, size = [], 0
                    yield rows()
        pack_shard(packer, shard, shared.value)
        packer.finish()
        yield rows()

    order = [*SIGNS, "id", "tag"]
    ranged = tokens.select(*order, "ids").repartitionByRange(parts, *order)
    ordered = ranged.sortWithinPartitions(*order).select("id", "ids")
    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in _FIELDS))


_FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

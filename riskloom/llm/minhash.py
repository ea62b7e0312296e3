"""b-bit MinHash near-duplicate detection.

A document's set is its distinct ``k``-word shingles; two documents link when the Jaccard similarity
of their sets reaches ``num / den``.

1. One pass takes ``bands * rows`` minima of multiply hashes per set. Each band's minima make one key;
   of every minimum only the low ``bits`` bits are retained, packed into longs.
2. Documents with equal sets (a 128-bit digest) are one node, so copies cost nothing further.
3. Candidates: nodes that share a band key. In a list of one key each node is paired with one drawn
   node, the list's hub, so a list of any length gives a pair per node.
4. The packed signatures of a pair are compared by bit counts. Two different minima agree in ``bits``
   bits with probability 2^-bits, so ``(agreeing - 2^-bits) / (1 - 2^-bits)`` estimates the similarity;
   a pair goes on if that is no more than ``sigmas`` standard deviations below the threshold. Parities
   (512 bits, each flipped by the shingles of one hash class) bound the difference of two sets exactly
   and rule out more.
5. The rest is confirmed on the full sets, built from the whole texts, and makes links.
6. Lists that still hold several components draw other hubs; at last all pairs of a list that lie in
   different components pass through 4 and 5. Pairs inside a component cannot change it.

So nothing false is linked, and no candidate is dropped. A link of similarity s is no candidate with
probability ``(1 - s^rows)^bands``: 6e-9 at 0.85 with 40 bands of 6, and fails the estimate with less
than 1e-8 (6 deviations). The tables that move hold signatures, keys and, of nodes in lists, the texts.

Defined cases: a null or empty text has an empty set and links with nothing; fewer words than ``k``
make one shingle; equal rows and null ids are rows of their own, a component of null ids alone has a
null id; an empty table has no rows. Extra columns are not read.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import blocks as B
from riskloom.llm import sets
from riskloom.llm.graph import components
from riskloom.llm.names import R1, R2, mixed
from riskloom.llm.sets import PARITIES, PARITY, Similarity
from riskloom.storage import materialise, scratch

#: Rounds that draw hubs, before all pairs that are still apart are compared.
HUB_ROUNDS = 3


@dataclass(frozen=True)
class Sketch:
    """Bands of minima, the bits kept of each, and the tolerance of the estimate."""

    bands: int = 40
    rows: int = 6
    bits: int = 2
    sigmas: float = 6.0

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def longs(self) -> int:
        return -(-self.minima * self.bits // 64)

    def columns(self) -> list[str]:
        return [f"s{i}" for i in range(self.longs)]

    def odd_numbers(self) -> np.ndarray:
        return mixed(np.arange(1, self.minima + 1, dtype=np.uint64) * R1) | np.uint64(1)

    def least_estimate(self, similarity: float) -> float:
        """Estimates of pairs of this similarity lie above, but for ``sigmas`` deviations."""
        chance = 2.0**-self.bits
        agree = similarity + (1 - similarity) * chance
        return similarity - self.sigmas * sqrt(agree * (1 - agree) / self.minima) / (1 - chance)

    def estimate(self, a: str, b: str) -> str:
        """SQL: the collision-corrected similarity of the signatures of two aliases."""
        ones = sum(1 << i for i in range(0, 64, self.bits))
        mask = ones - (1 << 64) if ones >> 63 else ones
        counts = []
        for c in self.columns():
            folded, step = f"({a}.{c} ^ {b}.{c})", self.bits // 2
            while step:
                folded = f"({folded} | shiftrightunsigned({folded}, {step}))"
                step //= 2
            counts.append(f"bit_count({folded} & {mask}L)")
        chance = 2.0**-self.bits
        agreeing = f"(1D - ({' + '.join(counts)}) / {float(self.minima)}D)"
        return f"(({agreeing} - {chance}D) / {1 - chance}D)"


def minima_of(shingles: list[np.ndarray], sketch: Sketch) -> np.ndarray:
    """Minima (one row per set) of non-empty sets."""
    flat = np.concatenate(shingles)
    heads = np.cumsum([0, *(len(s) for s in shingles[:-1])])
    out = np.empty((sketch.minima, len(shingles)), np.uint64)
    for row, odd in zip(out, sketch.odd_numbers()):
        np.minimum.reduceat(flat * odd, heads, out=row)
    return mixed(out.T.copy())


def band_keys(minima: np.ndarray, sketch: Sketch) -> np.ndarray:
    """One key per band and set; a band's number is part of its keys."""
    grouped = minima.reshape(len(minima), sketch.bands, sketch.rows)
    keys = mixed(np.arange(1, sketch.bands + 1, dtype=np.uint64) * R2) + np.zeros((len(minima), 1), np.uint64)
    for i in range(sketch.rows):
        keys = mixed(keys * R1 + grouped[:, :, i])
    return keys.astype(np.int64)


def packed(minima: np.ndarray, sketch: Sketch) -> np.ndarray:
    """The low bits of the minima, as longs."""
    per_long = 64 // sketch.bits
    low = np.zeros((len(minima), sketch.longs * per_long), np.uint64)
    low[:, : sketch.minima] = minima & np.uint64((1 << sketch.bits) - 1)
    shifts = np.arange(per_long, dtype=np.uint64) * np.uint64(sketch.bits)
    parts = low.reshape(len(minima), sketch.longs, per_long) << shifts
    return np.bitwise_or.reduce(parts, axis=2).astype(np.int64)


def _signed(rows: DataFrame, sim: Similarity, sketch: Sketch) -> DataFrame:
    """(id, tag, n, digest, keys, s0 ..., p0 ...) of each row; keys are null for an empty set."""
    columns = [*sketch.columns(), *PARITY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sets.pieces(batch):
                found = sets.shingle_sets(part.column("text").to_pylist(), sim.k)
                full = [i for i, s in enumerate(found) if len(s)]
                signs = np.zeros((len(found), sketch.longs + PARITIES), np.int64)
                keys: list = [None] * len(found)
                if full:
                    minima = minima_of([found[i] for i in full], sketch)
                    for i, k in zip(full, band_keys(minima, sketch)):
                        keys[i] = k
                    signs[full, : sketch.longs] = packed(minima, sketch)
                    signs[full, sketch.longs :] = [sets.parities(found[i]) for i in full]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("tag"),
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                        *map(pa.array, signs.T.copy()),
                    ],
                    ["id", "tag", "n", "digest", "keys", *columns],
                )

    schema = "id long, tag long, n long, digest binary, keys array<long>, "
    return rows.mapInArrow(run, schema + ", ".join(f"{c} long" for c in columns))


def _close(a: str, b: str, sim: Similarity, sketch: Sketch) -> str:
    """SQL: sizes, parities and the estimate allow a link of two aliases."""
    least = sketch.least_estimate(sim.num / sim.den)
    sizes = f"{sim.den} * least({a}.n, {b}.n) >= {sim.num} * greatest({a}.n, {b}.n)"
    return f"{sizes} AND {sets.near(a, b, sim)} AND {sketch.estimate(a, b)} >= {least}D"


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` (key, node) with ``label``: their component, of lists that hold more than one."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    found = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = found.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    return found.join(apart.where("x <> y").select("key"), "key", "left_semi")


def _hub_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a node and the hub that its list draws in this turn.

    In the first turn a hub is the list's smallest node, so that the lists of a group of near copies
    agree on it; then each list draws its own.
    """
    draw = F.col("node") if turn == 0 else F.xxhash64("node", "key", F.lit(turn))
    hubs = members.groupBy("key").agg(F.min(F.struct(draw.alias("draw"), "node", "label")).alias("hub"))
    met = members.join(hubs, "key").where("hub.node <> node AND hub.label <> label")
    a, b = F.least("node", "hub.node"), F.greatest("node", "hub.node")
    return met.select(a.alias("a"), b.alias("b")).distinct()


def _passing(pairs: DataFrame, nodes: DataFrame, sim: Similarity, sketch: Sketch) -> DataFrame:
    """The pairs whose signatures allow a link."""
    x = nodes.select("node", "n", *sketch.columns(), *PARITY)
    met = (
        pairs.join(x.withColumnRenamed("node", "a").alias("s"), "a")
        .join(x.withColumnRenamed("node", "b").alias("t"), "b")
        .where(_close("s", "t", sim, sketch))
    )
    return met.select("a", "b")


def _all_pairs(apart: DataFrame, nodes: DataFrame, sim: Similarity, sketch: Sketch) -> DataFrame:
    """Pairs of nodes that share a list, lie in different components and may link."""
    full = apart.join(nodes.select("node", "n", *sketch.columns(), *PARITY), "node")
    full = materialise(full, "apart_signed")
    close = f"s.key = t.key AND s.label <> t.label AND s.node < t.node AND {_close('s', 't', sim, sketch)}"
    met = full.alias("s").join(full.alias("t"), F.expr(close))
    return met.select(F.col("s.node").alias("a"), F.col("t.node").alias("b")).distinct()


def _components(
    members: DataFrame, nodes: DataFrame, texts: DataFrame, sim: Similarity, sketch: Sketch
) -> DataFrame:
    """(node, label) of all nodes with links."""
    labels = links = tested = None
    for turn in range(HUB_ROUNDS + 1):
        apart = materialise(_labelled(members, labels), "apart")
        if labels is not None and apart.isEmpty():
            break
        if turn < HUB_ROUNDS:
            met = _passing(_hub_pairs(apart, turn), nodes, sim, sketch)
        else:
            met = _all_pairs(apart, nodes, sim, sketch)
        met = materialise(met if tested is None else met.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = sets.verify(met, texts, sim)
        tested = met if tested is None else tested.unionByName(met)
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        B.release(members.sparkSession)
    return labels


def linked(docs: DataFrame, sim: Similarity, sketch: Sketch) -> DataFrame:
    """Per row: id, tag, n and ``least``, the smallest (id, tag) that links reach."""
    with scratch(docs.sparkSession, keep=("signed", "least_rows")):
        rows = sets.rows(docs)
        signed = materialise(_signed(rows, sim, sketch), "signed")
        columns = ["n", "keys", *sketch.columns(), *PARITY]
        first = F.min(F.struct("id", "tag", *columns)).alias("first")
        nodes = signed.where("n > 0").groupBy("digest").agg(first)
        # A row number through a one-to-one hash: unique, and in no order that links could follow.
        name = F.xxhash64(F.monotonically_increasing_id()).alias("node")
        nodes = materialise(nodes.select(name, "digest", "first.*"), "nodes")

        # Members of lists of two nodes or more, and the text of each.
        entries = nodes.select("node", F.explode("keys").alias("key"))
        held = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
        members = entries.join(held.where("low <> high").select("key"), "key")
        members = materialise(members, "members")
        B.release(docs.sparkSession)
        inside = members.select("node").distinct()
        wanted = materialise(nodes.select("node", "id", "tag").join(inside, "node", "left_semi"), "wanted")
        texts = sets.marked(rows, wanted).join(wanted, ["id", "tag"])
        texts = texts.dropDuplicates(["node"]).select(F.col("node").alias("fp"), "text")
        texts = B.by_key(texts, "fp", max(1, -(-wanted.count() // 20_000)))
        B.release(docs.sparkSession)

        labels = _components(members, nodes, texts, sim, sketch)
        named = nodes.select("node", "digest", F.struct("id", "tag").alias("own"))
        named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = materialise(named, "labelled")
        least = named.groupBy("label").agg(F.min("own").alias("least"))
        least = materialise(named.join(least, "label").select("digest", "least"), "least_rows")
    return signed.select("id", "tag", "n", "digest").join(least, "digest", "left").select(
        "id", "tag", "n", F.coalesce("least", F.struct("id", "tag")).alias("least")
    )


def report(docs: DataFrame, sim: Similarity, sketch: Sketch | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, and whether it is the one that is kept."""

    def back(column):
        return F.when(column != B.NO_ID, column)

    found = linked(docs.select("doc_id", "text"), sim, sketch or Sketch())
    return found.select(
        back(F.col("id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        back(F.col("least.id")).alias("component_id"),
        (F.col("id") == F.col("least.id")).alias("kept"),
    )

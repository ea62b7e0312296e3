"""Second-order gradient boosting on histograms, for rows that lie in many partitions.

1. Columns are cut at weighted quantiles (``sketches``), at most ``bins - 1`` cuts each.
2. Rows are packed into pages of one byte per column and written once; no row leaves its page again.
3. A tree grows level by level. Each task adds up gradients and second derivatives of its rows per
   (node, column, bin). These sums, of a fixed size whatever the number of rows, move by groups of
   columns to tasks that combine them and pick the best cut of every node among their columns. Only
   these picks, a few numbers per node and group, reach the driver.
4. After a tree each page's margins are moved on where they are. Pages are persisted, and every
   ``CHECKPOINT`` trees a checkpoint cuts their lineage, so a lost executor costs a few trees of work.

A tree draws its columns, and a row its part in a tree by a hash of its key, so a task that is run
again draws the same. Gradients are added as whole numbers of a fixed unit: sums do not depend on
the order of partitions, and the same rows in other partitions give the same trees.

With gradient sum G and second-derivative sum H, a node's leaf is ``-rate * G / (H + penalty)`` and a
split gains ``(GL^2 / (HL + penalty) + GR^2 / (HR + penalty) - G^2 / (H + penalty)) / 2``. Of equal
gains the first column and the lowest cut win. A missing value counts as larger than every cut.
"""

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.risk import hard_class
from riskloom.operators.sketches import column_sketches
from riskloom.operators.trees import FlatTrees
from riskloom.schema import FEATURES, KEY, LABEL
from riskloom.storage import materialise, shared_root

# The task functions travel with the plan, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE_ROWS = 1 << 16
CHECKPOINT = 20
LEAST_GAIN = 1e-12
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Boosting:
    """Settings of a fit."""

    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    bins: int = 256
    penalty: float = 1.0
    min_child: float = 1.0
    seed: int = 42

    def columns_of(self, tree: int, n: int) -> np.ndarray:
        """The columns that a tree may use, in order."""
        some = max(1, int(round(self.column_share * n)))
        return np.sort(np.random.default_rng([self.seed, tree]).permutation(n)[:some])

    def drawn(self, keys: np.ndarray, tree: int) -> np.ndarray:
        """Whether each row takes part in a tree."""
        with np.errstate(over="ignore"):
            x = keys.astype(np.uint64) + np.uint64((self.seed * 1_000_003 + tree + 1) * _STEP % 2**64)
            for shift, factor in ((30, _MIX1), (27, _MIX2)):
                x = (x ^ (x >> np.uint64(shift))) * factor
            x ^= x >> np.uint64(31)
        return x < np.uint64(min(int(self.row_share * 2.0**64), 2**64 - 1))


#: Bins by row, labels, weights, keys and the margins so far, of some rows of one partition.
Page = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Tree:
    """Nodes in levels: the children of node i are 2i + 1 and 2i + 2; ``column`` is -1 at a leaf."""

    column: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def nodes_of(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row reaches within so many levels."""
        at = np.zeros(len(bins), np.int64)
        line = np.arange(len(bins))
        for _ in range(levels):
            column = self.column[at]
            right = bins[line, column] > self.bin[at]
            at = np.where(column >= 0, 2 * at + 1 + right, at)
        return at


def derivatives(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Weighted first and second derivatives of the log loss at the page's margins."""
    _, label, weight, _, margin = page
    p = 1.0 / (1.0 + np.exp(-margin))
    return weight * (p - label), weight * np.maximum(p * (1.0 - p), 1e-16)


def page_sums(
    page: Page, tree: Tree, number: int, level: int, columns: np.ndarray, unit: float, fit: Boosting
) -> np.ndarray:
    """Whole-number sums (2, nodes of the level, columns, bins) of one page."""
    bins, key = page[0], page[3]
    first = 2**level - 1
    nodes = tree.nodes_of(bins, level)
    rows = np.flatnonzero((nodes >= first) & fit.drawn(key, number))
    out = np.zeros((2, first + 1, len(columns), fit.bins), np.int64)
    if not len(rows):
        return out
    g, h = (np.rint(x[rows] * unit) for x in derivatives(page))
    base = (nodes[rows] - first) * fit.bins
    size = (first + 1) * fit.bins
    for i, c in enumerate(columns):
        place = base + bins[rows, c]
        for side, x in enumerate((g, h)):
            sums = np.bincount(place, x, size)  # exact: a page's sums stay below 2^53
            out[side, :, i] = sums.reshape(first + 1, fit.bins).astype(np.int64)
    return out


def best_cuts(sums: np.ndarray, columns: np.ndarray, unit: float, fit: Boosting) -> np.ndarray:
    """The best cut per node among some columns, with their combined sums.

    One row per node: gain, column, cut, first and second derivatives on the left, on the right and of all.
    """
    left = np.cumsum(sums, axis=3)
    total = left[:, :, :1, -1:]
    gl, hl = left / unit
    g, h = total / unit
    gr, hr = (total - left) / unit
    gains = (gl**2 / (hl + fit.penalty) + gr**2 / (hr + fit.penalty) - g**2 / (h + fit.penalty)) / 2
    gains = np.where((hl >= fit.min_child) & (hr >= fit.min_child), gains, -np.inf)
    node = np.arange(len(gains))
    column, cut = np.divmod(gains.reshape(len(node), -1).argmax(axis=1), fit.bins)
    sides = [x[node, column, cut] for x in (gl, hl, gr, hr)]
    return np.column_stack([gains[node, column, cut], columns[column], cut, *sides, g[:, 0, 0], h[:, 0, 0]])


def split(tree: Tree, level: int, picks: list[np.ndarray], fit: Boosting) -> bool:
    """Set the splits of a level and the leaf values of their two sides; False if no node was split.

    ``picks`` are the ``best_cuts`` of all groups of columns, in the order of the columns.
    """
    first, found = 2**level - 1, False
    picks = np.stack(picks)
    for node in range(first + 1):
        at = first + node
        gain, column, cut, gl, hl, gr, hr, g, h = picks[picks[:, node, 0].argmax(), node]
        if level == 0:
            tree.value[0] = -fit.rate * g / (h + fit.penalty)
        if at and tree.column[(at - 1) // 2] < 0:
            continue
        if gain > LEAST_GAIN:
            tree.column[at], tree.bin[at], tree.gain[at] = int(column), int(cut), gain
            for side, gs, hs in ((1, gl, hl), (2, gr, hr)):
                tree.value[2 * at + side] = -fit.rate * gs / (hs + fit.penalty)
            found = True
    return found


def _moved(page: Page, tree: Tree, depth: int) -> Page:
    *held, margin = page
    return *held, margin + tree.value[tree.nodes_of(page[0], depth)]


_PAGE = "n long, bins binary, label binary, weight binary, key binary"


def _pages(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Pages of at most PAGE_ROWS rows; written, so that every later read sees the same."""
    columns = len(cuts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def page() -> pa.RecordBatch:
            bins, label, weight, key = (np.concatenate(x) for x in zip(*held))
            arrays = [bins, label, weight, key]
            return pa.RecordBatch.from_arrays(
                [pa.array([len(key)], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)],
                ["n", "bins", "label", "weight", "key"],
            )

        for batch in batches:
            n = batch.num_rows
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, columns)
            bins = np.empty((n, columns), np.uint8)
            for i, at in enumerate(cuts):
                bins[:, i] = np.searchsorted(at, x[:, i], side="left")
            held.append((bins, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight", "key"))))
            if sum(len(h[0]) for h in held) >= PAGE_ROWS:
                yield page()
                held = []
        if sum(len(h[0]) for h in held):
            yield page()

    return materialise(rows.mapInArrow(pack, _PAGE), "pages")


def _page_of(row, columns: int) -> Page:
    return (
        np.frombuffer(row["bins"], np.uint8).reshape(row["n"], columns),
        np.frombuffer(row["label"]),
        np.frombuffer(row["weight"]),
        np.frombuffer(row["key"], np.int64),
        np.zeros(row["n"]),
    )


@dataclass
class BoostedTrees:
    """A fitted model: the margin that rows start with, and trees over raw values."""

    start: float
    trees: FlatTrees
    gains: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))

    @property
    def featureImportances(self) -> "BoostedTrees":  # noqa: N802 - as Spark's models call it
        return self

    def toArray(self) -> np.ndarray:  # noqa: N802
        """Each feature's share of the mean gains."""
        total = self.gains.sum()
        return self.gains / total if total else self.gains

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.start + self.trees.leaves(x).sum(axis=1))))

    def __call__(self, scaled: DataFrame) -> DataFrame:
        """``scaled`` with ``p`` and ``prediction``, by Arrow batches."""

        @F.pandas_udf("double")
        def p(x: pd.Series) -> pd.Series:
            out = [self.probability(np.stack(x.iloc[a : a + 512].to_numpy())) for a in range(0, len(x), 512)]
            return pd.Series(np.concatenate(out) if out else np.zeros(0))

        scored = scaled.withColumn("p", p(F.array(*[F.col(f"`{c}`").cast("double") for c in FEATURES])))
        return scored.withColumn("prediction", hard_class(F.col("p")))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.trees.to_frame(spark).coalesce(1).write.parquet(f"{path}/trees")
        gains = [(i, float(g)) for i, g in enumerate(self.gains)]
        spark.createDataFrame(gains, "feature int, gain double").coalesce(1).write.parquet(f"{path}/gains")
        # Written last: a model without its metadata is not there.
        about = spark.createDataFrame([(type(self).__name__, self.start)], "kind string, start double")
        about.coalesce(1).write.json(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedTrees":
        start = spark.read.schema("kind string, start double").json(f"{path}/metadata").first()["start"]
        gains = spark.read.parquet(f"{path}/gains").orderBy("feature").collect()
        trees = FlatTrees.from_frame(spark.read.parquet(f"{path}/trees"))
        return BoostedTrees(start, trees, np.array([r["gain"] for r in gains]))


def _finished(grown: list[Tree], cuts: list[np.ndarray], columns: int) -> BoostedTrees:
    rows, gains, used = [], np.zeros(columns), np.zeros(columns)
    for number, tree in enumerate(grown):
        reached = [0]
        for at in reached:
            c = int(tree.column[at])
            if c < 0:
                rows.append((number, at, 0, 0.0, -1, -1, float(tree.value[at])))
                continue
            reached += [2 * at + 1, 2 * at + 2]
            gains[c] += tree.gain[at]
            used[c] += 1
            rows.append((number, at, c, float(cuts[c][tree.bin[at]]), 2 * at + 1, 2 * at + 2, 0.0))
    # Nodes are numbered anew without gaps, in the order of their levels.
    place: dict[tuple[int, int], int] = {}
    count: dict[int, int] = {}
    for number, at, *_ in rows:
        place[number, at] = count[number] = count.get(number, -1) + 1
    rows = [
        (t, place[t, at], f, cut, *((place[t, a], place[t, b]) if a >= 0 else (-1, -1)), value)
        for t, at, f, cut, a, b, value in rows
    ]
    return BoostedTrees(0.0, FlatTrees.of(rows), gains / np.maximum(used, 1))


def fit_trees(train: DataFrame, fit: Boosting, weight: str = "weight") -> BoostedTrees:
    """Fit on rows with a vector ``features``, the label, a weight and a unique key."""
    spark = train.sparkSession
    x = vector_to_array("features")
    rows = train.select(
        x.alias("x"),
        F.col(LABEL).cast("double").alias("label"),
        F.col(weight).cast("double").alias("weight"),
        F.coalesce(F.col(KEY).cast("long"), F.lit(0)).alias("key"),
    )
    columns = len(FEATURES)
    wide = rows.select(*[F.col("x")[i].alias(f"x{i}") for i in range(columns)], "weight")
    sketches = column_sketches(wide, [f"x{i}" for i in range(columns)], "weight")
    cuts = [sketches[f"x{i}"].cuts(fit.bins - 1) for i in range(columns)]
    weights = rows.agg(F.count("*").alias("n"), F.sum("weight").alias("total"), F.max("weight").alias("most")).first()
    if not weights["total"]:
        raise ValueError("Cannot fit: no rows with a weight.")
    # The unit is the finest for which all sums fit in 62 bits, and a page's in 53.
    spare = min(62 - np.log2(weights["total"]), 52 - np.log2(2 * PAGE_ROWS * weights["most"]))
    unit = float(2.0 ** min(30, np.floor(spare)))
    shared_root(spark)  # sets a checkpoint folder where a local session has none
    # Partitions of less than a page only cost tasks; no row is shuffled for this.
    packed = _pages(rows.coalesce(max(1, -(-weights["n"] // PAGE_ROWS))), cuts)
    pages = packed.rdd.map(lambda row: _page_of(row, columns))
    return _finished(_grow(pages, columns, unit, fit), cuts, columns)


def _grow(pages: RDD, columns: int, unit: float, fit: Boosting) -> list[Tree]:
    """All trees, level by level; pages move their margins on after each."""
    state, before = pages.persist(StorageLevel.MEMORY_AND_DISK), None
    groups = int(np.ceil(np.sqrt(state.getNumPartitions())))  # what one task combines grows with the root
    grown: list[Tree] = []
    for number in range(fit.rounds):
        tree, drawn = Tree.empty(fit.depth), fit.columns_of(number, columns)
        parts = np.array_split(np.arange(len(drawn)), min(len(drawn), groups))
        for level in range(fit.depth):

            def sums(found: Iterator[Page], tree=tree, number=number, level=level, drawn=drawn, parts=parts):
                total = None
                for page in found:
                    one = page_sums(page, tree, number, level, drawn, unit, fit)
                    total = one if total is None else total + one
                return [] if total is None else [(i, total[:, :, part]) for i, part in enumerate(parts)]

            def picks(found: Iterator[tuple[int, np.ndarray]], drawn=drawn, parts=parts):
                totals: dict[int, np.ndarray] = {}
                for i, one in found:
                    totals[i] = totals[i] + one if i in totals else one
                return [(i, best_cuts(total, drawn[parts[i]], unit, fit)) for i, total in totals.items()]

            summed = state.mapPartitions(sums)
            if len(parts) > 1:
                summed = summed.partitionBy(len(parts), int)
            best = [pick for _, pick in sorted(summed.mapPartitions(picks).collect(), key=lambda x: x[0])]
            if before is not None:  # the first level has read the new state
                before.unpersist()
                before = None
            if not split(tree, level, best, fit):
                break
        grown.append(tree)
        moved = state.map(lambda page, tree=tree: _moved(page, tree, fit.depth))
        moved.persist(StorageLevel.MEMORY_AND_DISK)
        if (number + 1) % CHECKPOINT == 0:
            moved.checkpoint()
        before, state = state, moved
    for rest in (before, state):
        if rest is not None:
            rest.unpersist()
    return grown

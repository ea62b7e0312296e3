"""Trees as flat arrays: how boosted trees are kept, and how one row is scored without a job."""

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The arrays travel with the plan, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "tree int, node int, feature int, cut double, low int, high int, value double"


@dataclass(frozen=True)
class FlatTrees:
    """All trees one after the other. A row goes to ``low`` where its feature is at most ``cut``.

    Leaves point to themselves, so ``depth`` steps bring every row of every tree to its leaf.
    """

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    depth: int

    @staticmethod
    def of(rows: list[tuple]) -> "FlatTrees":
        """From (tree, node, feature, cut, low, high, value) rows; ``low`` is negative at a leaf."""
        rows = sorted(rows, key=lambda r: r[:2])
        place = {r[:2]: i for i, r in enumerate(rows)}
        n = len(rows)
        feature, cut, value = np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
        low, high = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        level = [0] * n
        inner = set()
        for i, (tree, _, f, c, a, b, v) in enumerate(rows):
            value[i] = v
            if a >= 0:
                feature[i], cut[i], low[i], high[i] = f, c, place[tree, a], place[tree, b]
                inner |= {int(low[i]), int(high[i])}
                level[low[i]] = level[high[i]] = level[i] + 1  # children have larger numbers
        roots = np.array([i for i in range(n) if i not in inner], np.int32)
        return FlatTrees(roots, feature, cut, low, high, value, max(level, default=0))

    def rows(self) -> list[tuple]:
        tree = np.searchsorted(self.roots, np.arange(len(self.value)), side="right") - 1
        out = []
        for i, t in enumerate(tree.tolist()):
            base, leaf = int(self.roots[t]), bool(self.low[i] == i)
            ends = (-1, -1) if leaf else (int(self.low[i]) - base, int(self.high[i]) - base)
            out.append((t, i - base, int(self.feature[i]), float(self.cut[i]), *ends, float(self.value[i])))
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf values, one row per row of ``x`` and one column per tree."""
        at = np.tile(self.roots, (len(x), 1))
        line = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[line, self.feature[at]] <= self.cut[at], self.low[at], self.high[at])
        return self.value[at]

    def leaves_of_one(self, x: np.ndarray) -> np.ndarray:
        """Leaf values of one row, one per tree."""
        at = self.roots
        for _ in range(self.depth):
            at = np.where(x[self.feature[at]] <= self.cut[at], self.low[at], self.high[at])
        return self.value[at]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), T.StructType.fromDDL(SCHEMA))

    @staticmethod
    def from_frame(df: DataFrame) -> "FlatTrees":
        return FlatTrees.of([tuple(r) for r in df.select(*SCHEMA.replace(",", "").split()[::2]).collect()])


def forest_trees(nodes: DataFrame) -> FlatTrees:
    """The trees of a saved random forest; ``value`` is the share of class 1 in a leaf.

    ``nodes`` is the table of nodes that Spark's writer keeps beside the model.
    """
    n = nodes.select(
        "treeID",
        "nodeData.id",
        "nodeData.split.featureIndex",
        "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.leftChild",
        "nodeData.rightChild",
        "nodeData.impurityStats",
    )
    rows = []
    for tree, node, feature, cut, low, high, stats in n.collect():
        total = sum(stats)
        share = stats[1] / total if total > 0 else 0.0
        rows.append((tree, node, feature, cut[0] if low >= 0 else 0.0, low, high, share))
    return FlatTrees.of(rows)

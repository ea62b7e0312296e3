"""Mergeable weighted quantile sketches of numeric columns.

A sketch is a sorted list of values with the weight that ends at each. Up to ``size`` distinct values
it is exact. Beyond that, it holds the last value of each of ``size`` slices of equal weight, so a
rank that it gives is off by less than ``total / size`` for each time that it was made smaller: once
in the task that reads the rows and once per merge. Tasks send one sketch per column; they
are merged in two steps, so no task sees more than the sketches of a share of the partitions.
"""

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.numeric import known
from riskloom.storage import small_frame

# The task functions travel with the plan, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE = 4096
#: Sketches that one task of the first step merges share a number below this.
GROUPS = 64


@dataclass(frozen=True)
class Sketch:
    """``weights[i]`` lies above ``values[i - 1]`` and up to ``values[i]``; ``error`` bounds any rank."""

    values: np.ndarray
    weights: np.ndarray
    error: float = 0.0

    @property
    def total(self) -> float:
        return float(self.weights.sum())

    @staticmethod
    def of(values: np.ndarray, weights: np.ndarray | None = None, size: int = SIZE) -> "Sketch":
        """A sketch of numbers; NaN and null are not counted."""
        weights = np.ones(len(values)) if weights is None else np.asarray(weights, float)
        seen = ~np.isnan(values) & (weights > 0)
        distinct, place = np.unique(values[seen], return_inverse=True)
        return Sketch(distinct, np.bincount(place, weights[seen], len(distinct)))._smaller(size)

    def _smaller(self, size: int) -> "Sketch":
        if len(self.values) <= size:
            return self
        ends = np.cumsum(self.weights)
        slices = np.minimum((ends * (size / ends[-1])).astype(np.int64), size - 1)
        last = np.append(np.flatnonzero(np.diff(slices)), len(ends) - 1)
        kept = np.diff(ends[last], prepend=0.0)
        # A rank inside a kept slice is unknown by the weight below the slice's last value.
        inside = float((kept - self.weights[last]).max())
        return Sketch(self.values[last], kept, self.error + inside)

    def merge(self, other: "Sketch", size: int = SIZE) -> "Sketch":
        both = np.concatenate([self.values, other.values])
        distinct, place = np.unique(both, return_inverse=True)
        weights = np.bincount(place, np.concatenate([self.weights, other.weights]), len(distinct))
        return Sketch(distinct, weights, self.error + other.error)._smaller(size)

    def quantile(self, share: float) -> float:
        """A value whose rank is ``share * total``, up to ``error``."""
        ends = np.cumsum(self.weights)
        return float(self.values[min(np.searchsorted(ends, share * ends[-1]), len(ends) - 1)])

    def cuts(self, n: int) -> np.ndarray:
        """At most ``n`` values that part the weight evenly; the largest value is none of them."""
        if len(self.values) <= n + 1:
            return self.values[:-1]
        ends = np.cumsum(self.weights)
        at = np.searchsorted(ends, ends[-1] * np.arange(1, n + 1) / (n + 1))
        return np.unique(self.values[np.minimum(at, len(ends) - 2)])


_DDL = "name string, part int, vals binary, wts binary, err double"


def _row(name: str, part: int, sketch: Sketch) -> tuple:
    return name, part, sketch.values.tobytes(), sketch.weights.tobytes(), sketch.error


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.float64()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    names = ["name", "part", "vals", "wts", "err"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _sketch(row: dict) -> Sketch:
    return Sketch(np.frombuffer(row["vals"]), np.frombuffer(row["wts"]), row["err"])


def column_sketches(
    df: DataFrame, columns: list[str], weight: str | None = None, size: int = SIZE
) -> dict[str, Sketch]:
    """One sketch per column, from one scan. A column without values has an empty sketch."""
    weights = F.col(weight).cast("double") if weight else F.lit(1.0)
    numbers = [known(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = [Sketch(np.zeros(0), np.zeros(0))] * len(columns)
        for batch in batches:
            w = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            for i in range(len(columns)):
                x = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                found[i] = found[i].merge(Sketch.of(x, w, 4 * size), 4 * size)
        part = TaskContext.get().partitionId() % GROUPS
        yield _table([_row(c, part, s._smaller(size)) for c, s in zip(columns, found)])

    def merged(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sketch = _sketch(rows[0])
        for row in rows[1:]:
            sketch = sketch.merge(_sketch(row), size)
        return pa.Table.from_batches([_table([_row(rows[0]["name"], rows[0]["part"], sketch)])])

    parts = df.select(*numbers, weights.alias("w")).mapInArrow(read, _DDL)
    some = parts.groupBy("name", "part").applyInArrow(merged, _DDL)
    rows = some.groupBy("name").applyInArrow(merged, _DDL).collect()
    found = {r["name"]: _sketch(r.asDict()) for r in rows}
    return {c: found.get(c, Sketch(np.zeros(0), np.zeros(0))) for c in columns}


def save_sketches(spark: SparkSession, path: str, sketches: dict[str, Sketch]) -> None:
    rows = [
        (name, float(v), float(w), sketch.error)
        for name, sketch in sketches.items()
        for v, w in zip(sketch.values, sketch.weights)
    ]
    frame = small_frame(spark, rows, "name string, value double, weight double, error double")
    frame.coalesce(1).write.mode("overwrite").parquet(path)


def load_sketches(spark: SparkSession, path: str) -> dict[str, Sketch]:
    found: dict[str, list] = {}
    for r in spark.read.parquet(path).orderBy("name", "value").collect():
        found.setdefault(r["name"], []).append((r["value"], r["weight"], r["error"]))
    return {
        name: Sketch(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), rows[0][2])
        for name, rows in found.items()
    }

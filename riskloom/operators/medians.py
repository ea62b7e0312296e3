"""Exact column medians without sorting a column or holding its values in one task.

Spark's ``percentile`` keeps every distinct value of a column in one aggregation buffer. Here the
median is selected instead: approximate quantiles name two values around the middle rank, exact
counts tell on which side of them the rank lies, and only that part goes on. Each round leaves a
fraction of a percent of the rows. A value shared by a third of all rows is settled by its count.
"""

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.numeric import known
from riskloom.operators.cleaning import unify_missing
from riskloom.operators.sketches import Sketch, column_sketches
from riskloom.schema import FEATURES
from riskloom.storage import materialise

# The task functions travel with the plan, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SLACK = 0.001
_ACCURACY = 10_000


@dataclass
class _Search:
    """Looks for the values at some 0-based ranks of one column, strictly between two edges."""

    column: str
    ranks: list[int]
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None

    @property
    def values(self) -> Column:
        """The column inside the edges, NULL elsewhere."""
        c = F.col(self.column)
        if self.low is not None:
            c = F.when(F.col(self.column) > self.low, c)
        if self.high is not None:
            c = F.when(F.col(self.column) < self.high, c)
        return c

    def probe(self) -> Column:
        """Two values that should stand on both sides of the wanted ranks."""
        first = (self.ranks[0] - self.below) / self.inside
        last = (self.ranks[-1] - self.below) / self.inside
        shares = [max(0.0, first - _SLACK), min(1.0, last + _SLACK)]
        return F.percentile_approx(self.values, shares, _ACCURACY)

    def counts(self, low: float, high: float) -> Column:
        """Rows under the first value, at it, between the two, at the second if it is another one."""
        c = F.col(self.column)
        under = c < low if self.low is None else (c > self.low) & (c < low)
        at_high = F.count_if(c == high) if high > low else F.lit(0)
        return F.array(
            F.count_if(under), F.count_if(c == low), F.count_if((c > low) & (c < high)), at_high
        )

    def narrow(self, low: float, high: float, counts: list[int]) -> tuple[list, list]:
        """(values found, searches that go on): each rank moves to the one part that holds it.

        The probed values themselves drop out, so every round makes progress.
        """
        under, at_low, between, at_high = counts
        ends = list(accumulate([under, at_low, between, at_high], initial=self.below))
        parts = [
            _Search(self.column, [], under, ends[0], self.low, low),
            low,
            _Search(self.column, [], between, ends[2], low, high),
            high,
            _Search(self.column, [], self.inside - sum(counts), ends[4], high, self.high),
        ]
        found = []
        for rank in self.ranks:
            part = parts[sum(rank >= end for end in ends[1:])]
            if isinstance(part, _Search):
                part.ranks.append(rank)
            else:
                found.append(part)
        return found, [p for p in parts if isinstance(p, _Search) and p.ranks]


def _one_round(df: DataFrame, searches: list[_Search], found: dict) -> list[_Search]:
    edges = df.agg(*[s.probe().alias(f"s{i}") for i, s in enumerate(searches)]).first()
    counts = df.agg(*[s.counts(*edges[i]).alias(f"s{i}") for i, s in enumerate(searches)]).first()
    going_on = []
    for i, s in enumerate(searches):
        values, rest = s.narrow(*edges[i], counts[i])
        found[s.column] += values
        going_on += rest
    return going_on


def _finish(df: DataFrame, searches: list[_Search], found: dict) -> None:
    """Rank what is left of each search; ties are counted before they are shuffled."""
    listed = F.array(
        *[F.struct(F.lit(i).alias("i"), s.values.alias("value")) for i, s in enumerate(searches)]
    )
    known_only = F.filter(listed, lambda x: x["value"].isNotNull())
    places = F.array(*[F.array(*[F.lit(r - s.below) for r in s.ranks]) for s in searches])
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("value"))
    hits = (
        df.select(F.inline(known_only))
        .groupBy("i", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", upto)
        .withColumn("place", F.explode(F.get(places, F.col("i"))))
        .filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
    )
    for r in hits.collect():
        found[searches[r["i"]].column].append(r["value"])


def _known_rows(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    """(rows, rows with a value per column)."""
    counts = [F.count(known(F.col(c).cast("double"))).alias(f"n{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *counts).first()
    return row["n"], {c: row[f"n{i}"] for i, c in enumerate(columns)}


def exact_medians(
    df: DataFrame, columns: list[str], n: dict[str, int] | None = None, small: int = 500_000
) -> dict[str, float]:
    """Median of each column (mean of the two middle values); an all-missing column has none.

    ``n`` is the number of values per column, if known. ``small`` is the number of rows up to which
    the last step ranks a column in one task.
    """
    if not columns:
        return {}
    n = n or _known_rows(df, columns)[1]
    values = df.select([known(F.col(c).cast("double")).alias(c) for c in columns])
    searches = [
        _Search(c, sorted({(n[c] - 1) // 2, n[c] // 2}), n[c]) for c in columns if n[c]
    ]
    found: dict[str, list[float]] = {s.column: [] for s in searches}
    while wide := [s for s in searches if s.inside > small]:
        done = [s for s in searches if s.inside <= small]
        searches = done + _one_round(values, wide, found)
    if searches:
        _finish(values, searches, found)
    return {c: sum(middle) / len(middle) for c, middle in found.items()}


def _bracket(sketch: Sketch, first: int, last: int) -> tuple[float, float]:
    """(low, high]: holds the values at the 0-based ranks ``first`` to ``last`` for certain."""
    ends = np.cumsum(sketch.weights)
    under = np.flatnonzero(ends + sketch.error <= first)
    over = np.flatnonzero(ends - sketch.error >= last + 1)
    low = sketch.values[under[-1]] if len(under) else -math.inf
    return float(low), float(sketch.values[over[0]]) if len(over) else math.inf


def _candidates(df: DataFrame, brackets: dict[str, tuple[float, float]], weight: str | None) -> DataFrame:
    """(i, value, n) of the values inside the brackets; with a null value, the rows up to the low edge.

    One scan; equal values of a batch are one row.
    """
    names = list(brackets)
    edges = [brackets[c] for c in names]
    numbers = [known(F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(names)]
    weights = F.col(weight).cast("long") if weight else F.lit(1).cast("long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.column(len(names)).to_numpy(zero_copy_only=False)
            parts = []
            for i, (low, high) in enumerate(edges):
                x = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                below = int(many[x <= low].sum())
                inside = (x > low) & (x <= high)
                values, place = np.unique(x[inside], return_inverse=True)
                counts = np.bincount(place, many[inside], len(values)).astype(np.int64)
                parts += [(i, None, below)] if below else []
                parts += [(i, v, n) for v, n in zip(values.tolist(), counts.tolist())]
            columns = list(zip(*parts)) or [(), (), ()]
            kinds = (pa.int32(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["i", "value", "n"]
            )

    found = df.select(*numbers, weights.alias("n")).mapInArrow(read, "i int, value double, n long")
    return materialise(found.groupBy("i", "value").agg(F.sum("n").alias("n")), "median_candidates")


def medians_in_two_scans(
    df: DataFrame, columns: list[str], sketches: dict[str, Sketch] | None = None, small: int = 500_000
) -> dict[str, float]:
    """Exact medians: one scan sketches all columns, one brings the values around the middle.

    With ``sketches`` of all rows at hand (saved, and merged batch by batch) only the second scan is
    left. What lies in the brackets, a share of the rows that the sketch's error bounds, is narrowed
    down by sketches of its own while it is more than ``small`` distinct values.
    """
    sketches = sketches or column_sketches(df, columns)
    ranks, brackets, found = {}, {}, {}
    for c in columns:
        n = int(round(sketches[c].total))
        if n:
            ranks[c] = ((n - 1) // 2, n // 2)
            brackets[c] = _bracket(sketches[c], *ranks[c])
    weight = None
    while brackets:
        names = list(brackets)
        held = _candidates(df, brackets, weight)
        below = {names[r["i"]]: r["n"] for r in held.where("value IS NULL").collect()}
        ranks = {c: tuple(r - below.get(c, 0) for r in ranks[c]) for c in names}
        inside = held.where("value IS NOT NULL")
        sizes = {names[r["i"]]: r["count"] for r in inside.groupBy("i").count().collect()}
        done = [i for i, c in enumerate(names) if sizes.get(c, 0) <= small]
        values: dict[str, list] = {names[i]: [] for i in done}
        for r in inside.where(F.col("i").isin(done)).collect() if done else []:
            values[names[r["i"]]].append((r["value"], r["n"]))
        for c, pairs in values.items():
            pairs.sort()
            ends = np.cumsum([n for _, n in pairs])
            found[c] = sum(pairs[int(np.searchsorted(ends, r, side="right"))][0] for r in ranks[c]) / 2
        wide = [(i, c) for i, c in enumerate(names) if i not in done]
        df = inside.select("n", *[F.when(F.col("i") == i, F.col("value")).alias(c) for i, c in wide])
        weight = "n"
        nearer = column_sketches(df, [c for _, c in wide], "n") if wide else {}
        brackets = {c: _bracket(nearer[c], *ranks[c]) for _, c in wide}
    return found


def approximate_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """One-pass medians with a rank error of 1/10,000."""
    row = df.agg(
        *[F.percentile_approx(known(F.col(c)), 0.5, _ACCURACY).alias(c) for c in columns]
    ).first()
    return {c: row[c] for c in columns if row[c] is not None}


def fit_medians(df: DataFrame, columns=FEATURES, exact: bool = True) -> dict[str, float]:
    """Medians to keep as an artifact, for data that is scored later or arrives as a stream."""
    return exact_medians(df, list(columns)) if exact else approximate_medians(df, list(columns))


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Fill gaps with the given medians; a narrow projection."""
    filled = {c: F.coalesce(c, F.lit(float(m))) for c, m in medians.items() if c in df.columns}
    return unify_missing(df).withColumns(filled)


def batch_medians(df: DataFrame, columns=FEATURES) -> dict[str, float]:
    """Medians of the columns that have gaps in this batch; the others are not looked at."""
    present = [c for c in columns if c in df.columns]
    rows, n = _known_rows(df, present)
    return exact_medians(df, [c for c in present if n[c] < rows], n)


def impute_from_batch(df: DataFrame, columns=FEATURES) -> DataFrame:
    """Fill gaps with the medians of the batch itself."""
    return impute(df, batch_medians(df, columns))

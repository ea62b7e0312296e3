"""Exact k nearest neighbours of every point, by Euclidean distance with ties to the smaller id.

Points are assigned to the nearest of a bounded number of pivots, and cells side by side make regions
of about as many points as a task holds. Each point first searches its own region, which gives it a
distance bound; the triangle inequality then names the cells that can still hold a closer point, and
only their regions are searched. Regions are split into bounded parts on both sides, and a task holds
one pair of parts, so a dense cell becomes many tasks. A task halves its points into blocks and
compares a block only with the queries whose bound reaches the block's bounding box; bounds shrink
as it goes. Tasks return the best k+1 of a pair of parts, never the pairs. Copies of one point are
searched once.

Where points spread evenly in many dimensions no bound can rule out much, and the exact answer takes
time in the square of the number of points; clustered points take far less.
"""

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.hashing import digest
from riskloom.operators.joins import join_unique
from riskloom.schema import KEY
from riskloom.storage import materialise, small_frame

# The task functions travel with the plan, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CELLS_AT_ONCE = 500_000
_ROUNDING = 1e-12
#: Stands for a null id: larger than any other.
_NO_ID = np.iinfo(np.int64).max
#: Rows of each side that a task holds.
TASK_ROWS = 16_384
#: Most points of a block, and the coordinates that its bounding box looks at.
MOST_IN_BLOCK, BOX_AXES = 512, 8


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One coordinate at a time: equal points give exactly 0, and no 3-d array is built."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += gap * gap
    return out


def _chunks(rows: int, others: int) -> Iterator[slice]:
    """Row ranges whose distance matrices stay small."""
    step = max(1, _CELLS_AT_ONCE // max(1, others))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assign(pool: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot as ``cell`` and the distance to it as ``gap``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("v"))
            cell = np.empty(len(points), dtype=np.int32)
            gap = np.empty(len(points))
            for some in _chunks(len(points), len(pivots)):
                d2 = squared_distances(points[some], pivots)
                cell[some] = d2.argmin(axis=1)
                gap[some] = np.sqrt(d2.min(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(gap)], [*batch.schema.names, "cell", "gap"]
            )

    return pool.mapInArrow(run, "id long, v array<double>, copy int, cell int, gap double")


def _pair_distances(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row))
    for j in range(a.shape[1]):
        gap = a[row, j] - b[col, j]
        out += gap * gap
    return out


def _blocks(points: np.ndarray, rows: int) -> list[np.ndarray]:
    """Places of the points in blocks of at most ``rows``, halved along the widest coordinate."""
    parts, out = [np.arange(len(points))], []
    while parts:
        part = parts.pop()
        if len(part) <= rows:
            out.append(part)
            continue
        half = len(part) // 2
        order = np.argpartition(points[part, points[part].var(axis=0).argmax()], half)
        parts += [part[order[:half]], part[order[half:]]]
    return out


class _Best:
    """The best ``n`` candidates of each query so far, and the distance that a better one must keep."""

    def __init__(self, points: np.ndarray, bounds: np.ndarray, n: int):
        self.points, self.bounds, self.n = points, np.array(bounds), n
        self.d2 = np.full((len(points), n), np.inf)
        self.ids = np.full((len(points), n), _NO_ID)

    def meet(self, some: np.ndarray, ids: np.ndarray, others: np.ndarray, centre: np.ndarray) -> None:
        """Compare the queries at ``some`` with a block of candidates.

        A matrix product gives rough distances; pairs that could be among the best after allowing for
        its rounding error get exact ones, and only those decide.
        """
        n = self.n
        a, b = self.points[some] - centre, others - centre
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        rough = a @ (-2.0 * b.T)
        rough += bb
        slack = _ROUNDING * (aa + bb.max())
        limit = self.bounds[some] + slack - aa
        if len(ids) > n and not np.isfinite(limit).all():
            nth = np.partition(rough, n - 1, axis=1)[:, n - 1]
            limit = np.minimum(limit, nth + 2.0 * slack)
        row, col = np.nonzero(rough <= limit[:, None])
        d2 = _pair_distances(self.points[some], others, row, col)
        near = d2 <= self.bounds[some][row]
        row, col, d2 = row[near], col[near], d2[near]
        order = np.lexsort((ids[col], d2, row))
        row, col, d2 = row[order], col[order], d2[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < n
        row, col, d2, place = row[best], col[best], d2[best], place[best]
        hit, at = np.unique(row, return_inverse=True)
        both_d2 = np.concatenate([self.d2[some[hit]], np.full((len(hit), n), np.inf)], axis=1)
        both_ids = np.concatenate([self.ids[some[hit]], np.full((len(hit), n), _NO_ID)], axis=1)
        both_d2[at, n + place], both_ids[at, n + place] = d2, ids[col]
        order = np.lexsort((both_ids, both_d2), axis=1)[:, :n]
        self.d2[some[hit]] = np.take_along_axis(both_d2, order, axis=1)
        self.ids[some[hit]] = np.take_along_axis(both_ids, order, axis=1)
        self.bounds[some[hit]] = np.minimum(self.bounds[some[hit]], self.d2[some[hit], n - 1])


def _best_in_part(n: int, block_rows: int):
    """Task function: the best ``n`` candidates of one part for each query of one part."""
    rows = max(2 * n, min(block_rows, MOST_IN_BLOCK))

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        ids = pc.fill_null(candidates.column("id"), _NO_ID).to_numpy()
        qids = pc.fill_null(queries.column("qid"), _NO_ID).to_numpy()
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if len(ids) and len(qids):
            points, others = _matrix(queries.column("v")), _matrix(candidates.column("point"))
            best = _Best(points, queries.column("bound").to_numpy(), n)
            axes = np.argsort(-others.var(axis=0), kind="stable")[:BOX_AXES]
            seen = np.ascontiguousarray(points[:, axes].T)
            blocks = _blocks(others, rows)
            boxes = [(others[at][:, axes].min(axis=0), others[at][:, axes].max(axis=0)) for at in blocks]

            def apart(box) -> np.ndarray:
                """No point of the box is closer to the query than the root of this."""
                out = np.zeros(len(points))
                for column, low, high in zip(seen, *box):
                    gap = np.maximum(np.maximum(low - column, column - high), 0.0)
                    out += gap * gap
                return out

            def meet(some: np.ndarray, at: np.ndarray) -> None:
                block = others[at]
                for part in _chunks(len(some), len(at)):
                    best.meet(some[part], ids[at], block, block.mean(axis=0))

            # A query without a bound starts with the block that is nearest to it.
            first = np.full(len(points), -1)
            if not np.isfinite(best.bounds).all():
                least = np.full(len(points), np.inf)
                for i, box in enumerate(boxes):
                    gap = apart(box)
                    closer = (gap < least) & ~np.isfinite(best.bounds)
                    first[closer], least[closer] = i, gap[closer]
                for i, at in enumerate(blocks):
                    meet(np.flatnonzero(first == i), at)
            for i, (at, box) in enumerate(zip(blocks, boxes)):
                reach = best.bounds * (1 + 1e-9)
                meet(np.flatnonzero((apart(box) <= reach) & (first != i)), at)
            row, place = np.nonzero(np.isfinite(best.d2))
            found = [qids[row], best.ids[row, place], best.d2[row, place]]
        return pa.table(
            {
                "qid": pa.array(found[0], pa.int64(), mask=found[0] == _NO_ID),
                "nn_id": pa.array(found[1], pa.int64(), mask=found[1] == _NO_ID),
                "d2": pa.array(found[2], pa.float64()),
            }
        )

    return run


def _regions(pivots: np.ndarray, sizes: dict[int, int], rows: int) -> dict[int, int]:
    """The region of each cell: cells side by side that together hold at most ``rows``, or one cell."""
    cells = np.array(sorted(sizes))
    held = np.array([sizes[c] for c in cells.tolist()])
    parts, out = [np.arange(len(cells))], []
    while parts:
        part = parts.pop()
        if len(part) == 1 or held[part].sum() <= rows:
            out.append(part)
            continue
        centres = pivots[cells[part]]
        part = part[np.argsort(centres[:, centres.var(axis=0).argmax()], kind="stable")]
        upto = np.cumsum(held[part])
        half = int(np.clip(np.searchsorted(upto, upto[-1] / 2), 1, len(part) - 1))
        parts += [part[:half], part[half:]]
    return {c: i for i, part in enumerate(out) for c in cells[part].tolist()}


def _search(
    queries: DataFrame,
    pool: DataFrame,
    visits: dict[int, int],
    sizes: dict[int, int],
    n: int,
    block_rows: int,
    task_rows: int,
) -> DataFrame:
    """Best ``n`` candidates per query and part of the region that the query row names.

    ``visits`` and ``sizes`` are the query rows and the points of each region.
    """
    layout = [
        (region, math.ceil(sizes[region] / task_rows), math.ceil(visits[region] / task_rows))
        for region in visits
    ]
    layout = F.broadcast(
        small_frame(pool.sparkSession, layout, "region int, pool_parts int, query_parts int")
    )
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    task = ["region", "pool_part", "query_part"]
    left = (
        queries.join(layout, "region")
        .withColumn("query_part", part("qid", "query_parts"))
        .withColumn("pool_part", every("pool_parts"))
        .select(*task, "qid", "v", "bound")
    )
    right = (
        pool.select("id", F.col("v").alias("point"), F.col("region").alias("at_region"))
        .join(layout.withColumnRenamed("region", "at_region"), "at_region")
        .withColumn("pool_part", part("id", "pool_parts"))
        .withColumn("query_part", every("query_parts"))
        .select("at_region", *task[1:], "id", "point")
    )
    return (
        left.groupBy(*task)
        .cogroup(right.groupBy("at_region", *task[1:]))
        .applyInArrow(_best_in_part(n, block_rows), "qid long, nn_id long, d2 double")
    )


def _best(lists: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "nn_id"))
    return lists.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def _regions_in_reach(
    queries: DataFrame, pivots: np.ndarray, spans: dict, regions: dict[int, int], n: int
) -> DataFrame:
    """Per query, the other regions with a cell that may hold a point within its bound.

    Pivots are points themselves, so the n-th nearest pivot bounds the search as well; that helps
    queries whose own region holds fewer than ``n`` points.
    """
    cells = np.array(sorted(spans, key=lambda c: (regions[c], c)), dtype=np.int32)
    region_of = np.full(len(pivots), -1, dtype=np.int32)
    region_of[cells] = [regions[c] for c in cells.tolist()]
    names, heads = np.unique(region_of[cells], return_index=True)
    inner = np.array([spans[c][0] for c in cells])
    outer = np.array([spans[c][1] for c in cells])
    centres = pivots[cells]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("v"))
            own = batch.column("cell").to_numpy()
            gap = batch.column("gap").to_numpy()
            bound = batch.column("bound").to_numpy()
            bound = np.array(bound)
            reached = []
            for some in _chunks(len(points), len(cells)):
                d2 = squared_distances(points[some], centres)
                if len(cells) >= n:
                    nth = np.partition(d2, n - 1, axis=1)[:, n - 1]
                    bound[some] = np.minimum(bound[some], nth)
                d = np.sqrt(d2)
                apart = np.sqrt(squared_distances(pivots[own[some]], centres))
                with np.errstate(divide="ignore", invalid="ignore"):
                    border = (d2 - gap[some, None] ** 2) / (2.0 * apart)
                least = np.maximum(d - outer, inner - d)
                least = np.maximum(least, np.where(apart > 0, border, 0.0))
                reach = np.sqrt(bound[some])[:, None] * (1 + 1e-9) + 1e-9
                hits = np.logical_or.reduceat(least <= reach, heads, axis=1)
                hits &= names[None, :] != region_of[own[some], None]
                reached += [names[hit] for hit in hits]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("qid"),
                    batch.column("v"),
                    pa.array(bound),
                    pa.array(reached, pa.list_(pa.int32())),
                ],
                ["qid", "v", "bound", "regions"],
            )

    return queries.mapInArrow(run, "qid long, v array<double>, bound double, regions array<int>")


def nearest_neighbours(
    points: DataFrame,
    k: int = 5,
    key: str = KEY,
    vector: str = "features",
    block_rows: int = 4_096,
    max_pivots: int = 32_768,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``id, nn_rank (1..k), nn_id, distance`` for every point; a point is not its own neighbour.

    ``max_pivots`` bounds what tasks receive (pivots and cell radii), ``task_rows`` the rows of each
    side that one holds. From ``block_rows`` points on there are pivots; a block that is compared at once
    holds no more. None changes the answer. A point with a missing coordinate has no distance: it has
    no neighbours and is none. ``points`` is read more than once: pass a table.
    """
    n = k + 1
    vectors = F.col(vector).cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    points = points.select(F.col(key).alias("id"), vectors.alias("v")).filter(whole)
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    pool = materialise(
        points.withColumn("copy", copy).filter(F.col("copy") <= n), "distinct-points"
    )
    is_first = F.col("copy") == 1
    size, distinct = pool.agg(F.count(F.lit(1)), F.count_if(is_first)).first()
    n_pivots = 1 if size <= block_rows else min(max_pivots, math.ceil(math.sqrt(distinct)))
    chosen = pool.filter(is_first).orderBy(digest(0, "pivot", F.col("id"))).limit(n_pivots)
    pivots = np.array([r["v"] for r in chosen.select("v").collect()])
    cells = materialise(_assign(pool, pivots), "cells")
    stats = {
        r["cell"]: r
        for r in cells.groupBy("cell")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.count_if(is_first).alias("distinct"),
            F.min("gap").alias("inner"),
            F.max("gap").alias("outer"),
        )
        .collect()
    }
    regions = _regions(pivots, {c: r["size"] for c, r in stats.items()}, task_rows)
    sizes, own_visits = Counter(), Counter()
    for c, r in stats.items():
        sizes[regions[c]] += r["size"]
        own_visits[regions[c]] += r["distinct"]
    of_cell = small_frame(points.sparkSession, sorted(regions.items()), "cell int, region int")
    cells = cells.join(F.broadcast(of_cell), "cell")
    queries = cells.filter(is_first).withColumnRenamed("id", "qid")

    own = queries.select("qid", "v", F.lit(math.inf).alias("bound"), "region")
    own_visits = {r: v for r, v in own_visits.items() if v}
    lists = _best(_search(own, cells, own_visits, sizes, n, block_rows, task_rows), n)
    if len(sizes) > 1:
        lists = materialise(lists, "own-region")
        reached = lists.groupBy("qid").agg(
            F.when(F.count(F.lit(1)) < n, F.lit(math.inf)).otherwise(F.max("d2")).alias("bound")
        )
        spans = {c: (r["inner"], r["outer"]) for c, r in stats.items()}
        further = materialise(
            _regions_in_reach(queries.join(reached, "qid"), pivots, spans, regions, n), "reach"
        )
        by_region = further.select("qid", "v", "bound", F.explode("regions").alias("region"))
        visits = {r["region"]: r["count"] for r in by_region.groupBy("region").count().collect()}
        more = _search(by_region, cells, visits, sizes, n, block_rows, task_rows)
        lists = _best(lists.unionByName(more), n)
    near = lists.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("d2", "nn_id"))).alias("near")
    )
    if distinct == points.count():
        with_lists = near.withColumnRenamed("qid", "id")
    else:
        by_vector = queries.select("qid", "v").join(near, "qid").select("v", "near")
        with_lists = join_unique(points, materialise(by_vector, "lists"), "v")
    others = F.filter("near", lambda x: x["nn_id"] != F.col("id"))
    ranked = with_lists.select("id", F.posexplode(F.slice(others, 1, k)).alias("place", "nn"))
    return ranked.select(
        "id",
        (F.col("place") + 1).alias("nn_rank"),
        F.col("nn.nn_id").alias("nn_id"),
        F.sqrt("nn.d2").alias("distance"),
    )

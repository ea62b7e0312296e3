"""Row positions and running sums over a whole table without a one-task window.

Rows are range-partitioned on the full order, sorted inside each partition and written once. The
place of a row is then its place in its block plus the size of the earlier blocks. Block sizes are
one number per shuffle partition, so only they pass through the driver.
"""

import math
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.hashing import digest
from riskloom.schema import KEY
from riskloom.storage import materialise, small_frame

_BLOCK_BITS = 33
_BUCKETS = 10_000
_MAX_WANTED = 10_000


def in_order(df: DataFrame, order: list) -> DataFrame:
    """``df`` written in the given order, with its block and the place inside the block."""
    position = F.col("_position")
    return materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_position", F.monotonically_increasing_id()),
        "ordered",
    ).withColumns(
        {
            "_block": F.shiftright(position, _BLOCK_BITS).cast("int"),
            "_place": position.bitwiseAND(F.lit(2**_BLOCK_BITS - 1)),
        }
    )


def with_row(df: DataFrame, *order, row: str = "row") -> DataFrame:
    """Add the exact 1-based place of each row. The order must be total for a stable answer."""
    order = list(order) or [KEY]
    blocks = in_order(df, order)
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes.sort(key=lambda r: r["_block"])
    before = [0, *accumulate(r["n"] for r in sizes)]
    offsets = small_frame(
        df.sparkSession,
        [(r["_block"], start) for r, start in zip(sizes, before)],
        "_block int, _before long",
    )
    placed = blocks.join(F.broadcast(offsets), "_block")
    return placed.select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias(row))


def running_sum(
    df: DataFrame, order: list, columns: list[str], groups: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``<c>_sum`` (this row included), ``<c>_next`` (value of the row after) and ``<c>_all``
    (total) per group.

    Rows must be unique in the order; pre-aggregate ties first. Groups must be few: there is one
    number per group and block on the driver.
    """
    groups = list(groups)
    blocks = in_order(df, [*groups, *order])
    parts = (
        blocks.groupBy("_block", *groups)
        .agg(
            *[F.sum(c).alias(f"{c}_total") for c in columns],
            F.min_by(F.struct(*columns), "_place").alias("first"),
        )
        .collect()
    )
    parts.sort(key=lambda r: r["_block"])
    rows = []
    for key in {tuple(r[g] for g in groups) for r in parts}:
        mine = [r for r in parts if tuple(r[g] for g in groups) == key]
        before = dict.fromkeys(columns, 0)
        total = [sum(r[f"{c}_total"] for r in mine) for c in columns]
        for i, r in enumerate(mine):
            after = mine[i + 1]["first"] if i + 1 < len(mine) else dict.fromkeys(columns)
            rows.append(
                (*key, r["_block"], *[before[c] for c in columns], *[after[c] for c in columns], *total)
            )
            before = {c: before[c] + r[f"{c}_total"] for c in columns}
    fields = [
        *[f"{g} {df.schema[g].dataType.simpleString()}" for g in groups],
        "_block int",
        *[f"{c}_before long" for c in columns],
        *[f"{c}_after long" for c in columns],
        *[f"{c}_all long" for c in columns],
    ]
    edges = small_frame(df.sparkSession, rows, ", ".join(fields))
    inside = Window.partitionBy("_block", *groups).orderBy("_place")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = blocks.withColumns(
        {f"{c}_sum": F.sum(c).over(upto) for c in columns}
        | {f"{c}_next": F.lead(c).over(inside) for c in columns}
    ).join(F.broadcast(edges), ["_block", *groups])
    return summed.select(
        *df.columns,
        *[(F.col(f"{c}_before") + F.col(f"{c}_sum")).alias(f"{c}_sum") for c in columns],
        *[F.coalesce(f"{c}_next", f"{c}_after").alias(f"{c}_next") for c in columns],
        *[f"{c}_all" for c in columns],
    )


def rows_at(
    df: DataFrame, wanted: list[int], key: str = KEY, total: int | None = None, small: int = 1_000_000
) -> DataFrame:
    """Exactly the rows whose 1-based places in key order are ``wanted``, with ``row``.

    A large table is cut into buckets by approximate quantiles of a numeric key. Exact bucket counts show
    which buckets hold a wanted place, and only those rows are sorted. Of very many places every
    bucket holds some, so all rows are numbered.
    """
    wanted = sorted(set(wanted))
    if len(wanted) > _MAX_WANTED:
        places = small_frame(df.sparkSession, [(place,) for place in wanted], "row long")
        return with_row(df, key).join(places, "row")
    total = df.count() if total is None else total
    moved = [(place, place) for place in wanted]
    if total > small and isinstance(df.schema[key].dataType, T.NumericType):
        df, moved = _only_buckets_of(df, wanted, key)
    places = small_frame(df.sparkSession, moved, "row long, _true_row long")
    picked = with_row(df, key).join(F.broadcast(places), "row")
    return picked.drop("row").withColumnRenamed("_true_row", "row")


def _bucketed(df: DataFrame, key: str, cuts: list[float]) -> DataFrame:
    """Add ``_bucket``: bucket i holds the keys from the i-th cut up to the next."""
    return Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol="_key", outputCol="_bucket"
    ).transform(df.withColumn("_key", F.col(key).cast("double")))


def _bucket_sizes(bucketed: DataFrame) -> dict[int, int]:
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    return {int(r["_bucket"]): r["n"] for r in sizes.collect()}


def _only_buckets_of(df: DataFrame, wanted: list[int], key: str) -> tuple[DataFrame, list]:
    """Rows of the buckets that hold a wanted place, and where those places moved to."""
    shares = [i / _BUCKETS for i in range(1, _BUCKETS)]
    cuts = df.agg(F.percentile_approx(key, shares, 10 * _BUCKETS).alias("cuts")).first()["cuts"]
    bucketed = _bucketed(df, key, sorted({float(c) for c in cuts}))
    sizes = _bucket_sizes(bucketed)
    kept, moved, passed, skipped, i = [], [], 0, 0, 0
    for b in sorted(sizes):
        last = passed + sizes[b]
        start = i
        while i < len(wanted) and wanted[i] <= last:
            moved.append((wanted[i] - skipped, wanted[i]))
            i += 1
        if i > start:
            kept.append(float(b))
        else:
            skipped += sizes[b]
        passed = last
    return bucketed.filter(F.col("_bucket").isin(kept)).select(*df.columns), moved


def places_of(df: DataFrame, few: DataFrame, key: str = KEY, row: str = "row") -> DataFrame:
    """Add to a few rows of ``df`` their 1-based places in key order, without ordering ``df``.

    The keys of the few rows cut the table into ranges; counting those ranges is one pass that
    combines on the map side. Keys must be unique. Numbers beyond 2**53 are not exact as doubles;
    for those, for keys that are no numbers, and for more than 10,000 rows, the keys of the whole
    table are put in order.
    """
    few = materialise(few, "few")
    keys = [r[key] for r in few.select(key).limit(_MAX_WANTED + 1).collect()]
    numeric = isinstance(df.schema[key].dataType, T.IntegralType)
    if len(keys) > _MAX_WANTED or not numeric or any(abs(k) > 2**53 for k in keys):
        return with_row(df.select(key), key, row=row).join(few, key)
    keys.sort()
    sizes = _bucket_sizes(_bucketed(df, key, [float(k) for k in keys])) if keys else {}
    before = accumulate(sizes.get(i, 0) for i in range(len(keys)))
    places = [(k, n + 1) for k, n in zip(keys, before)]
    return few.join(F.broadcast(small_frame(df.sparkSession, places, f"{key} long, {row} long")), key)


def thin(df: DataFrame, key: str = KEY, target: int = 200) -> DataFrame:
    """Every ``step``-th row from the first, ``step = max(1, floor(n / target))``: under 2*target rows."""
    total = df.count()
    step = max(1, total // target)
    if total // step >= _MAX_WANTED:
        return with_row(df, key).where((F.col("row") - 1) % step == 0)
    return rows_at(df, list(range(1, total + 1, step)), key, total)


def time_sorted(df: DataFrame, key: str = KEY, row: str = "row") -> DataFrame:
    return with_row(df, "Time", key, row=row)


def shuffled(df: DataFrame, seed: int = 42, key: str = KEY, row: str = "row") -> DataFrame:
    """All rows in a seeded random order, each with its place in that order."""
    out = with_row(df.withColumn("_draw", digest(seed, "shuffle", F.col(key))), "_draw", key, row=row)
    return out.drop("_draw")

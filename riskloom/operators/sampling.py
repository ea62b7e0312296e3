"""Class partitions, exact stratified split, fixed-size draws with replacement, class mixes."""

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import digest, integer_below
from riskloom.operators.ordering import rows_at, shuffled, time_sorted, with_row
from riskloom.schema import KEY, LABEL

_FEW = 10_000
_DIGITS = 4
_MAX_HEADS = 2_000_000


def of_class(df: DataFrame, value: int, label: str = LABEL) -> DataFrame:
    """Rows of one class without the label."""
    return df.filter(F.col(label) == value).drop(label)


def stack(*frames: DataFrame) -> DataFrame:
    """Union by column name, duplicates kept."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def train_sizes(counts: dict, test_fraction: float) -> dict:
    """Training rows per class: the total test size rounds up, largest remainders share the rest."""
    total = sum(counts.values())
    n_train = total - math.ceil(total * test_fraction)
    shares = {c: n_train * n / total for c, n in counts.items()}
    sizes = {c: math.floor(share) for c, share in shares.items()}
    by_remainder = sorted(shares, key=lambda c: (sizes[c] - shares[c], c is not None, c or 0))
    for c in by_remainder[: n_train - sum(sizes.values())]:
        sizes[c] += 1
    return sizes


@dataclass
class _Cut:
    """Looks for the draw at one place (from 1) of one class, digit by digit."""

    label: int
    place: int
    prefix: str = ""
    inside: int = 0
    draw: str | None = None

    def narrow(self, counts: dict[str, int]) -> None:
        """``counts`` are rows per longer prefix; move to the one that holds the place."""
        for digits in sorted(counts):
            if self.place <= counts[digits]:
                self.prefix, self.inside = digits, counts[digits]
                return
            self.place -= counts[digits]


def _find_cuts(df: DataFrame, cuts: list[_Cut], label: str) -> None:
    """Settle all cuts; ``df`` has the label and the draw only. One job per round for all classes."""
    while open_cuts := [c for c in cuts if c.draw is None]:
        wide = [c for c in open_cuts if c.inside > _FEW and len(c.prefix) < 32]
        at = wide or open_cuts
        inside = df.filter(
            reduce(or_, [F.col(label).eqNullSafe(F.lit(c.label)) & F.col("_draw").startswith(c.prefix) for c in at])
        )
        if wide:
            longest = max(len(c.prefix) for c in wide)
            grouped = _count_heads(inside, longest + _DIGITS, label)
            for c in wide:
                mine = grouped[c.label]
                c.narrow({d: n for d, n in mine.items() if d.startswith(c.prefix)})
        else:
            draws: dict = {}
            for r in inside.collect():
                draws.setdefault(r[label], []).append(r["_draw"])
            for c in at:
                c.draw = sorted(draws[c.label])[c.place - 1]


def _count_heads(df: DataFrame, digits: int, label: str) -> dict[int, dict[str, int]]:
    head = F.substring("_draw", 1, digits).alias("head")
    heads = df.groupBy(label, head).agg(F.count(F.lit(1)).alias("n"))
    rows = heads.limit(_MAX_HEADS + 1).collect()
    if len(rows) > _MAX_HEADS:
        raise ValueError(f"Too many values of {label} for a split by class.")
    out: dict = {}
    for r in rows:
        out.setdefault(r[label], {})[r["head"]] = r["n"]
    return out


def with_part(
    df: DataFrame,
    test_fraction: float = 0.2,
    seed: int = 42,
    key: str = KEY,
    label: str = LABEL,
) -> DataFrame:
    """Add ``part`` (train or test) with exact class counts; a narrow projection over ``df``.

    Each row has a draw that depends on its key alone, and a class gives the rows with its smallest
    draws to the test set. The driver learns only one cut per class: counts per leading hex digits
    of the draw lead to the digits that hold the cut, then to the cut itself. No row is shuffled.
    Keys must be unique; classes must be few. Rows without a label are a class of their own.
    """
    draw = digest(seed, "split", F.col(key))
    draws = df.select(label, draw.alias("_draw"))
    heads = _count_heads(draws, _DIGITS, label)
    counts = {c: sum(n.values()) for c, n in heads.items()}
    sizes = train_sizes(counts, test_fraction)
    cuts = [_Cut(c, counts[c] - sizes[c]) for c in counts if counts[c] > sizes[c]]
    for c in cuts:
        c.narrow(heads[c.label])
    _find_cuts(draws, cuts, label)
    in_test = reduce(
        or_, [F.col(label).eqNullSafe(F.lit(c.label)) & (draw <= c.draw) for c in cuts], F.lit(False)
    )
    return df.withColumn("part", F.when(in_test, "test").otherwise("train"))


def stratified_split(
    df: DataFrame,
    test_fraction: float = 0.2,
    seed: int = 42,
    key: str = KEY,
    label: str = LABEL,
) -> tuple[DataFrame, DataFrame]:
    """(train, test), two filters over ``with_part``."""
    parts = with_part(df, test_fraction, seed, key, label)
    return tuple(parts.filter(F.col("part") == name).drop("part") for name in ("train", "test"))


def bootstrap(df: DataFrame, n: int, seed: int = 42, tag: str = "pick", key: str = KEY) -> DataFrame:
    """Exactly ``n`` rows drawn with replacement, numbered by ``draw`` from 0."""
    spark = df.sparkSession
    total = df.count()
    if n and not total:
        raise ValueError("Cannot draw from an empty frame.")
    draws = spark.range(n).select(
        F.col("id").alias("draw"), (integer_below(total, seed, tag, F.col("id")) + 1).alias("row")
    )
    if n <= _FEW:
        wanted = [r["row"] for r in draws.select("row").distinct().collect()]
        pool, draws = rows_at(df, wanted, key, total), F.broadcast(draws)
    else:
        pool = with_row(df, key)
    return pool.join(draws, "row").drop("row")


@dataclass
class MixPart:
    """One class of a mix: how many rows, and columns to replace (built from the draw number)."""

    n: int
    overrides: dict[str, Column] = field(default_factory=dict)


def class_mix(
    df: DataFrame, legit: MixPart, fraud: MixPart, order: str = "shuffled", seed: int = 42
) -> DataFrame:
    """``legit.n`` + ``fraud.n`` rows drawn with replacement, in ``shuffled`` or ``time`` order.

    ``mix_id`` is unique (legit draws first), ``tx_id`` names the source row, ``row`` is the place.
    """
    parts = []
    for name, value, part, start in (("legit", 0, legit, 0), ("fraud", 1, fraud, legit.n)):
        if part.n:
            drawn = bootstrap(of_class(df, value), part.n, seed, f"pick-{name}")
            drawn = drawn.withColumns(part.overrides)
            parts.append(drawn.withColumn("mix_id", F.col("draw") + start).drop("draw"))
    mixed = stack(*parts)
    if order == "time":
        return time_sorted(mixed, "mix_id")
    return shuffled(mixed, seed, "mix_id")

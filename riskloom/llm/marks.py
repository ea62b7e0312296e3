"""Bitmaps of 64-bit hashes: most rows that a join or a filter cannot concern stay out of its shuffle.

A bitmap has a bounded size: the fuller it is, the more other rows are marked. So whatever is done
with marked rows must be exact by itself.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap, 64 in a row: at most 2^18 rows go to every executor.
MARKS = 1 << 24


def with_marks(rows: DataFrame, wanted: DataFrame, name: str, mark: str) -> DataFrame:
    """``rows`` with a column ``mark``: true if the hash ``name`` is among ``wanted``'s, rarely else."""
    word = f"shiftright({name} & {MARKS - 1}, 6)"
    bit = F.expr(f"shiftleft(1L, int({name} & 63))")
    bits = wanted.groupBy(F.expr(word).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    held = rows.join(F.broadcast(bits), F.expr(f"{word} = _word"), "left")
    hit = F.coalesce(F.expr(f"bit_get(_bits, int({name} & 63)) = 1"), F.lit(False))
    return held.select(*[rows[c] for c in rows.columns], hit.alias(mark))


def marked(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The ``rows`` whose hash ``name`` is among ``wanted``'s, and a few others."""
    return with_marks(rows, wanted, name, "_marked").where("_marked").drop("_marked")

"""Random numbers as a pure function of (seed, tag, key).

``rand(seed)`` depends on how rows are partitioned, so a retried task or another cluster size
changes the draw. A digest of the row key does not, and any SQL engine can repeat it.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 13 hex digits: exact in a double, and enough for draws below any table size.
_DIGITS, _WORD = 13, 2.0**52


def digest(seed: int, tag: str, key: Column) -> Column:
    """32 hex digits for one key; also the sort key of a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}|{tag}|"), key.cast("string")))


def _word(hexdigits: Column, start: int) -> Column:
    return F.conv(F.substring(hexdigits, start, _DIGITS), 16, 10).cast("double")


def uniform(seed: int, tag: str, key: Column) -> Column:
    """U[0, 1) from the first 52 bits of the digest."""
    return _word(digest(seed, tag, key), 1) / F.lit(_WORD)


def uniform_between(low: float, high: float, seed: int, tag: str, key: Column) -> Column:
    return F.lit(float(low)) + uniform(seed, tag, key) * F.lit(float(high - low))


def integer_below(bound: Column | int, seed: int, tag: str, key: Column) -> Column:
    """Integer in 0..bound-1."""
    bound = F.lit(bound) if isinstance(bound, int) else bound
    return F.floor(uniform(seed, tag, key) * bound.cast("double"))


def gaussian(seed: int, tag: str, key: Column) -> Column:
    """N(0, 1) by Box-Muller from two words of one digest."""
    hexdigits = digest(seed, tag, key)
    radius = F.sqrt(F.lit(-2.0) * F.ln((_word(hexdigits, 1) + 1.0) / F.lit(_WORD)))
    return radius * F.cos(F.lit(2.0 * math.pi) * (_word(hexdigits, 1 + _DIGITS) / F.lit(_WORD)))


def gaussian_constant(seed: int, tag: str) -> float:
    """The draw ``gaussian`` gives for the key ``constant``, as a Python number."""
    import hashlib

    hexdigits = hashlib.md5(f"{seed}|{tag}|constant".encode()).hexdigest()
    u1 = (int(hexdigits[:_DIGITS], 16) + 1.0) / _WORD
    u2 = int(hexdigits[_DIGITS : 2 * _DIGITS], 16) / _WORD
    return math.sqrt(-2.0 * math.log(u1)) * math.cos(2.0 * math.pi * u2)

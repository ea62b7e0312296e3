"""Column expressions on texts that several operators share."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column, separators: str = SPACE) -> Column:
    """The words between separators; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, every other letter unchanged. A word of ASCII takes the fast way."""
    ascii_only = F.octet_length(word) == F.char_length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))

"""Quality rules, line first: failing lines go, then documents that lose too much text.

All measures come from array functions within a row, so nothing is shuffled and a document of any
length is one row's work. Repeated windows of eight words are found by 64-bit window hashes; the
hash of a window is built by doubling (pairs, fours, eights).

Defined cases: a null or empty text has no words and is rejected (fewer than ``min_words``).
Every input row gives one output row, repeated rows and null ids included. Columns of the input
other than the id and the text are not read, so extra columns cannot clash.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import words_of
from riskloom.storage import materialise

WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class QualityRules:
    """Parameters of the rules. Percentages are integers, so that no rounding decides."""

    min_words: int = 20
    max_repeat_pct: int = 30
    max_lost_pct: int = 50
    #: A line of text ends in one of these.
    line_end: str = r"[.!?…:;\"'”’»)\]][\x20\x09-\x0D]*$"
    #: More than this share of symbols makes a line noise.
    symbols: str = r"[#*$%&|<>]"
    max_symbol_pct: int = 10
    #: A menu: three or more short items between separators. Items hold no separator, so possessive
    #: loops match the same lines, and take no stack: a line may have any number of items.
    navigation: str = r"^[^.!?]{0,40}(?:[|»›>•·/][^.!?|»›>•·/]{1,30}+){2,}+$"
    boilerplate: str = (
        r"(?i)all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)"
        r"|accept (all )?cookies|subscribe to our|sign up for our|javascript is (disabled|required)"
        r"|click here to|lorem ipsum"
    )


def line_fails(line: Column, rules: QualityRules) -> Column:
    """Whether a line breaks the punctuation, navigation or boilerplate rule."""
    symbols = F.regexp_count(line, F.lit(rules.symbols))
    return (
        ~line.rlike(rules.line_end)
        | (symbols * 100 > F.char_length(line) * rules.max_symbol_pct)
        | line.rlike(rules.navigation)
        | line.rlike(rules.boilerplate)
    )


def _n(values: Column) -> Column:
    return F.size(values).cast("long")


def _doubled(hashes: Column, step: int) -> Column:
    """Hashes of twice as many words, from hashes that start ``step`` words apart."""
    later = F.slice(hashes, F.lit(step + 1), F.size(hashes))
    return F.slice(
        F.zip_with(hashes, later, lambda a, b: F.xxhash64(a, b)),
        F.lit(1),
        F.greatest(F.size(hashes) - step, F.lit(0)),
    )


def _covered(windows: Column, sorted_windows: Column, width: int) -> Column:
    """Words in windows whose hash occurs twice. ``sorted_windows`` holds (hash, place) in order."""
    same = F.zip_with(
        sorted_windows,
        F.slice(sorted_windows, F.lit(2), F.size(windows)),
        lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)),
    )
    marked = F.zip_with(
        F.zip_with(same, F.concat(F.array(F.lit(False)), same), lambda a, b: a | b),
        sorted_windows,
        lambda hit, w: F.when(hit, w["i"]),
    )
    places = F.sort_array(F.array_compact(marked))
    steps = F.zip_with(
        places,
        F.slice(places, F.lit(2), F.size(windows)),
        lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)),
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)


def measure(docs: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """Per document: the base measures, ``base_failed``, ``kept`` and ``clean_text``."""
    rules = rules or QualityRules()
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text")).withColumn("words", words_of(F.col("text")))
    df = df.select(
        "doc_id",
        "text",
        _n(F.col("words")).alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    for step in (1, 2, 4):
        df = df.withColumn("h", _doubled(F.col("h"), step))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    df = df.withColumn(
        "sorted",
        F.when(
            repeats,
            F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    df = df.withColumn(
        "good", F.filter("lines", lambda x: ~line_fails(x, rules))
    ).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (_n(F.col("lines")) - _n(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.col("sorted").isNotNull(), _covered(F.col("h"), F.col("sorted"), 8))
        .otherwise(F.lit(0).cast("long"))
        .alias("n_repeat_words"),
        _n(F.col("good")).alias("n_good_lines"),
        F.char_length(F.array_join("lines", "")).alias("_all"),
        F.char_length(F.array_join("good", "")).alias("_left"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    base = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_pct
    )
    lost = (F.col("_all") - F.col("_left")) * 100 > F.col("_all") * rules.max_lost_pct
    return df.withColumn("base_failed", base).withColumn("kept", ~base & ~lost).drop("_all", "_left")


def clean(docs: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """The kept documents with all their columns; failing lines are gone from their texts.

    Rows keep their own other columns because the measures are taken beside them, in one struct.
    """
    columns = [c for c in docs.columns if c != "text"]
    row = F.struct(F.col("text").isNull().alias("_"), *[F.col(f"`{c}`") for c in columns])
    packed = docs.select(F.col("text"), row.alias("doc_id"))
    # Written before the filter: pushed below the measures, it would repeat all of them.
    judged = measure(packed, rules).select("doc_id", "clean_text", "kept")
    judged = materialise(judged, "judged").where("kept")
    fields = {c: F.col("doc_id")[c].alias(c) for c in columns}
    fields["text"] = F.col("clean_text").alias("text")
    if "n_chars" in fields:
        kind = docs.schema["n_chars"].dataType
        fields["n_chars"] = F.char_length("clean_text").cast(kind).alias("n_chars")
    return judged.select(*[fields[c] for c in docs.columns])

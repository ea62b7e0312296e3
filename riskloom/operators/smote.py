"""Synthetic minority rows on the segments between a row and one of its nearest neighbours."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import integer_below, uniform
from riskloom.operators.joins import join_unique
from riskloom.operators.neighbours import nearest_neighbours
from riskloom.operators.ordering import with_row
from riskloom.operators.weights import class_counts
from riskloom.schema import FEATURES, KEY, LABEL
from riskloom.storage import materialise


def smote_count(n_majority: int, n_minority: int, ratio: float = 0.1, k: int = 5) -> int:
    """How many rows to make so that minority : majority becomes ``ratio``."""
    wanted = int(n_majority * ratio - n_minority)
    if wanted <= 0:
        raise ValueError("The minority is already at or above the wanted ratio.")
    if n_minority <= k:
        raise ValueError(f"Need more than {k} minority rows, got {n_minority}.")
    return wanted


def synthesise(
    minority: DataFrame,
    n_new: int,
    n_minority: int,
    k: int = 5,
    seed: int = 42,
    block_rows: int = 4_096,
) -> DataFrame:
    """``n_new`` rows with negative keys; ``base_id``, ``nn_id`` and ``step`` tell their origin.

    Base row, neighbour and step are independent draws of the new row's number.
    """
    spark = minority.sparkSession
    vectors = minority.select(KEY, F.array(*FEATURES).alias("features"))
    numbered = materialise(with_row(vectors, KEY), "minority")
    near = nearest_neighbours(numbered, k, block_rows=block_rows)
    number = F.col("id")
    draws = spark.range(n_new).select(
        (-number - 1).alias(KEY),
        (integer_below(n_minority, seed, "base", number) + 1).alias("row"),
        (integer_below(k, seed, "neighbour", number) + 1).cast("int").alias("nn_rank"),
        uniform(seed, "step", number).alias("step"),
    )
    bases = numbered.select("row", F.col(KEY).alias("base_id"), F.col("features").alias("base"))
    picked = (
        draws.join(bases, "row")
        .join(near.select(F.col("id").alias("base_id"), "nn_rank", "nn_id"), ["base_id", "nn_rank"])
        .drop("row", "nn_rank")
    )
    ends = numbered.select(F.col(KEY).alias("nn_id"), F.col("features").alias("end"))
    both = join_unique(materialise(picked, "smote-picks"), ends, "nn_id")
    made = F.zip_with("base", "end", lambda a, b: a + F.col("step") * (b - a))
    return both.withColumn("made", made).select(
        KEY,
        *[F.get("made", F.lit(i)).alias(c) for i, c in enumerate(FEATURES)],
        "base_id",
        "nn_id",
        "step",
    )


def smote(
    train: DataFrame, ratio: float = 0.1, k: int = 5, seed: int = 42, block_rows: int = 4_096
) -> DataFrame:
    """The training rows and the synthetic rows of the smaller class. Never pass test rows."""
    counts = class_counts(train)
    if len(counts) != 2:
        raise ValueError(f"Need two classes, got {sorted(counts)}.")
    rare = min(counts, key=lambda c: (counts[c], -c))
    common = next(c for c in counts if c != rare)
    n_new = smote_count(counts[common], counts[rare], ratio, k)
    minority = train.filter(F.col(LABEL) == rare)
    new = synthesise(minority, n_new, counts[rare], k, seed, block_rows)
    columns = [KEY, LABEL, *FEATURES]
    label = F.lit(rare).cast(train.schema[LABEL].dataType).alias(LABEL)
    return train.select(columns).unionByName(new.select(KEY, label, *FEATURES))

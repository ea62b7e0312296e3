"""A training-data pipeline over ``documents``: five stages, each one operator of the library.

Each stage gets what its predecessor kept and gives back the same columns; the last gives the pieces
of the packed sequences. Stages are written as Parquet, so a lost executor costs one stage's tasks.
A stage starts when its predecessor's result is written, so it first drops the tables that the
predecessor has worked with.

Defined cases: an empty table passes every stage; a null or empty text has no words and goes in the
first stage; equal rows are one document for the second stage, rows with a null id stay apart by their
texts; very long texts are one row's work in every stage; extra columns of ``documents`` pass all stages
but the last, which reads doc_id and text.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import decontamination, jaccard, packing, quality, secret_scan, sets
from riskloom.storage import drop_made, made_since, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that the last stage has left, by session.
_left: dict[int, list] = {}


def _stage(work: Stage) -> Stage:
    """``work``, after the tables of the stage before are dropped."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_made(spark, _left.pop(id(spark), []))
        mark = len(made_since())
        out = work(spark, docs, sf_dir)
        _left[id(spark)] = made_since(mark)
        return out

    run.__doc__ = work.__doc__
    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, then documents that the rules reject."""
    return quality.clean(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_one(docs, sets.Similarity(k=5, num=80, den=100))


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any ten-word window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.drop_contaminated(docs, items, width=10)


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets found in its text are replaced by a mark."""
    return secret_scan.redact(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The tokenizer has no counterpart in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None

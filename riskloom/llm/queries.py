"""The operators' registered queries: each runs over the whole tables it is meant for."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    codes,
    decontamination,
    infilling,
    jaccard,
    merkle,
    minhash,
    packing,
    quality,
    recompression,
    secret_scan,
    sets,
    sharding,
    suffixes,
    url_filters,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10
    )


def list_changes(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts by rules on digits of the host's MD5.

    One host in five is listed, a third of these for 60 days only; one in eleven has its parent
    domain listed, one in seven its folder of French pages.
    """
    host = url_filters.host_of(F.col("url"))
    hosts = pages.select(host.alias("host")).where("host <> ''").distinct()
    m = F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("long")
    hosts = hosts.withColumn("m", m)
    category = F.element_at(
        F.array(F.lit("ads"), F.lit("adult"), F.lit("malware")), (F.col("m") % 3 + 1).cast("int")
    )
    day = (F.col("m") % 200).cast("int")

    def entry(key, start, action):
        return F.struct(
            key.alias("key"), category.alias("category"), start.alias("day"), F.lit(action).alias("action")
        )

    parent = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    m = F.col("m")
    changes = F.array_compact(
        F.array(
            F.when(m % 5 == 0, entry(F.col("host"), day, "add")),
            F.when(m % 15 == 0, entry(F.col("host"), day + 60, "remove")),
            F.when(m % 11 == 0, entry(parent, day + 30, "add")),
            F.when(m % 11 == 0, entry(parent, day + 40, "remove")),
            F.when(m % 7 == 0, entry(F.concat("host", F.lit("/fr")), day, "add")),
        )
    )
    return hosts.select(F.explode(changes).alias("c")).select("c.*")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture of the day ``page_id mod 365``."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", (F.col("page_id") % 365).cast("int"))
    judged = url_filters.judge(captures, list_changes(pages))
    return judged.select(
        F.col("row.page_id").alias("page_id"),
        "host",
        F.col("row.day").alias("day"),
        F.array_join("categories", ",").alias("categories"),
        (F.size("categories") > 0).alias("blocked"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), shards=24)


def op9_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return codes.report(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(_table(spark, sf_dir, "documents")).drop("clean_text")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(_table(spark, sf_dir, "documents"), sets.Similarity(k=4, num=85))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return recompression.remove_repeats(docs, width=35, with_text=False)


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"), length=50, with_text=False)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(_table(spark, sf_dir, "documents"), sets.Similarity(k=5, num=85))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(_table(spark, sf_dir, "documents"))


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.report(_table(spark, sf_dir, "documents"), seed=1, plain_from=90, spm_below=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filters": op2_url_filters,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sharding": op7_sharding,
    "op8_secret_scans": op8_secret_scans,
    "op9_token_codes": op9_token_codes,
    "op10_suffix_arrays": op10_suffix_arrays,
    "op11_minhash": op11_minhash,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_infilling": op13_infilling,
}

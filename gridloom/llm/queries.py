"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.alignment import aligned
from gridloom.llm.fingerprints import edit_fingerprints
from gridloom.llm.jaccard import groups
from gridloom.llm.langid import identified
from gridloom.llm.minhash import near_duplicates
from gridloom.llm.packing import packed
from gridloom.llm.phrases import collocations
from gridloom.llm.pieces import encoded
from gridloom.llm.quality import judged
from gridloom.llm.session import documents
from gridloom.llm.substring import deduplicated
from gridloom.llm.suffixes import deduplicated_bytes
from gridloom.llm.tokencounts import token_counts
from gridloom.llm.warc import round_trip


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir), width=50).drop("kept_text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir), width=5, percent=75).drop("row", "first")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).drop("row")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_bytes(documents(spark, sf_dir), width=200)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2, percent=80)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), longest=3, least=10, share=50, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and "_" in k and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {}

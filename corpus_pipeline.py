"""The corpus pipeline: stages over documents, each written and read again before the next.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the last
returns the pieces of the packed sequences. No stage can be expressed in SQL on whole tables fast enough to compare
(the learned model not at all), so ORACLE_SQL is None and the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import jaccard, langid, quality, substring
from gridloom.llm.packing import packed
from gridloom.llm.session import documents, written

ORACLE_SQL = None


def packed_up(docs: DataFrame) -> DataFrame:
    """doc_id, text, source, and all other columns as one struct, so that none clashes with what an operator adds."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = ["source"] if "source" in docs.columns else []
    return docs.select("doc_id", "text", *own, F.struct(*(F.col(f"`{c}`") for c in rest)).alias("others")) if rest else docs


def shortened(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of docs from rows with kept_text and the others in a struct."""
    values = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*((values[c] if c in values else F.col("others").getField(c)).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or of which no language holds 40 % of the words, go."""
    return langid.recognised(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules or are depleted of their own lines go; the others lose the lines their host shares."""
    rows = packed_up(docs)
    return shortened(docs, quality.judged(rows, carry=tuple(c for c in rows.columns if c == "others")).where("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (of repeated rows of it, the first)."""
    return jaccard.first_of_groups(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words or more that a document with a smaller id has are removed from the texts."""
    rows = packed_up(docs)
    return shortened(docs, substring.deduplicated(rows, width=50, carry=tuple(c for c in rows.columns if c == "others")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("language", language),
    ("quality", rules),
    ("near_copies", near_copies),
    ("passages", passages),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = written(out, f"pipeline-{name}") if k + 1 < len(STAGES) else out
    return docs

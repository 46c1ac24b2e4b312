"""The corpus pipeline: toxic documents go, repeated chunks of lines go, one document of each near-duplicate group
stays, sources are mixed to target weights, and what is left is packed into windows.

Each stage's result is written as Parquet and read again as the next stage's documents. All stages but the last return
the columns of documents; a document that the mix takes twice is two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barwright.llm.common import written
from barwright.llm.line_chunks import without_repeats
from barwright.llm.mixing import mixed
from barwright.llm.near_dedup import NearDedup, deduplicated
from barwright.llm.packing import Packing, pack
from barwright.llm.queries import vocabulary
from barwright.llm.toxicity import clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half, all columns as they were. Texts without words stay; repeated rows stay or go
    together; null doc_ids and other null columns make no difference; no documents give none."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the chunks of lines that an earlier one holds; n_chars is set anew. Null and empty texts
    stay as they are; rows that repeat doc_id and text lose the same chunks; null doc_ids come first."""
    return without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by the words and similarity of op1. Texts without words all stay; of
    repeated rows one stays; null doc_ids come last when a group's document is chosen."""
    return deduplicated(docs, NearDedup(words=3, percent=85))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per draw of a document, so a document may occur twice. Texts without words are not in a mix; a null source
    is one source; repeated rows are drawn alike."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows; a null or empty text is the end id alone; each repeated row is packed."""
    return pack(docs, Packing(vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Models, sketches, the splitting tree and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

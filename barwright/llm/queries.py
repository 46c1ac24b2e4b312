"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path
from . import line_chunks, media, negatives, resampling, url_filter
from .mixing import mix_plan
from .near_dedup import NearDedup, near_duplicates
from .packing import Packing, pack
from . import toxicity
from .passages import repeated_passages
from .syncmers import fingerprints_and_edits
from .token_counts import TokenCounts, token_counts
from .token_files import TokenFiles, read_token_files, with_crc32, write_token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDedup(words=3, percent=85))


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "draws")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), Packing(vocabulary("byte_bpe_50k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_and_edits(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, TokenFiles(vocabulary("word_bpe_49k.json")))
    return with_crc32(read_token_files(spark, path))


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_chunks.line_dedup(table(spark, sf_dir, "documents"))
    kept = F.col("kept_text")
    return rows.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.length(kept).cast("long").alias("kept_chars"), F.md5(kept.cast("binary")).alias("kept_md5"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
    labelled = spark.createDataFrame(url_filter.labelled_urls(), "url string, label int")
    return url_filter.judge(table(spark, sf_dir, "pages"), labelled, url_filter.UrlFilter(rules))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents"))
    pages = media.interleaved(stored.select(F.struct("doc_id", "n_bytes").alias("document"), "html"), "document")
    rows = media.resolved(pages, "document", media.features(stored))
    return rows.select("document.doc_id", "document.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), TokenCounts(vocabulary("piece_bpe_32k.model")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_syncmers": op4_syncmers,
    "op5_token_files": op5_token_files,
    "op6_line_chunks": op6_line_chunks,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_passages": op9_passages,
    "op10_media": op10_media,
    "op11_resampling": op11_resampling,
    "op12_token_counts": op12_token_counts,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op6_line_chunks": line_chunks.sql(),
    "op11_resampling": resampling.sql(),
    "op13_hard_negatives": negatives.sql(),
}

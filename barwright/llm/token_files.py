"""Token ids in Parquet files for selective reads."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, small_batches
from .tokens import encoder


@dataclass(frozen=True)
class TokenFiles:
    """tokenizer: its file. end_id: the id after each document. row_group, page: bytes in the Parquet files; small pages
    and their index (which the writer always adds) let a reader fetch a few documents. rows: most rows of a page. remembered: words of which
    a worker keeps the ids."""

    tokenizer: str
    end_id: int = 1
    row_group: int = 16 << 20
    page: int = 256 << 10
    rows: int = 2000
    remembered: int = 1_200_000


SHAPE = "part int, doc_id long, part_start long, n_tokens long, tokens array<int>"


def write_token_files(docs: DataFrame, path: str, c: TokenFiles) -> None:
    """Encodes every text and writes part, doc_id, part_start, n_tokens and tokens in ascending doc_id order.

    ``part`` numbers the files in that order; ``part_start`` counts the ids of the documents before it in its file.
    Token lists are dictionary encoded (a vocabulary has few values), the ascending columns are delta encoded.
    Null doc_ids come first; rows with equal doc_ids are ordered by a hash of the text, so that many of them, and equal
    rows too, are parted among tasks. A null text is empty, so its list is the end id alone. An empty table gives files
    without rows.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, start = encoder(c.tokenizer, c.remembered), TaskContext.get().partitionId(), 0
        end = np.array([c.end_id], "<u4").tobytes()
        for b in chunks(batches, 128):
            ids = [x + end for x in words.encode(b.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(n)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), b.column(0), pa.array(start + ends - n), pa.array(n), tokens], ["part", "doc_id", "part_start", "n_tokens", "tokens"])
            start += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", "hash", "place"]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    flat = {f"parquet.enable.dictionary#{x}": "false" for x in ("part", "doc_id", "part_start", "n_tokens")}
    options = flat | {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.block.size": str(c.row_group),
        "parquet.page.size": str(c.page),
        "parquet.page.row.count.limit": str(c.rows),
    }
    rows.mapInArrow(run, SHAPE).write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before. Only columns that are used are read; the offsets
    of files come from their metadata columns alone and have one row per file."""
    from pyspark.sql import Window as W

    rows = spark.read.schema(SHAPE).parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sums.select("part", before.alias("before")))  # a row per file, as many as the writing shuffle had partitions
    return rows.join(offsets, "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before")


def with_crc32(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            lists = b.column(3)
            data, at = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B"), lists.offsets.to_pylist()
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

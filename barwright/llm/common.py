"""Shared helpers: tables in the cluster's shared folder, word splitting, text hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets a folder of its
    own; any other master is an error, since executors couldn't see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="barwright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/barwright/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes a DataFrame as Parquet into the shared folder and returns a DataFrame that reads it.

    It cuts the lineage: later steps read files that survive the loss of executors.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> F.Column:
    """All columns of a table in one struct, whatever their names hold."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to 4 MB, so that what tasks and workers hold of long texts stays small beside
    their memory. Results don't depend on it; Spark's own bound lets a batch grow to many times that."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def word_count(text) -> F.Column:
    """Number of words of a string column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    LIMIT = 1 << 16

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def lower_words(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased; other letters stay."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """Finishes 64-bit hashes and drops the lowest bit, so that they fit a signed long in the same order."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (h ^ (h >> np.uint64(33))) >> np.uint64(1)


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """A 63-bit hash for each run of ``size`` words, in order; a shorter text is one run, no words are none."""
    n = len(word_hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    size, short = min(size, n), n < size
    h = np.full(n - size + 1, size + 77 * short, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : n - size + 1 + i]
    return mixed(h).view(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most, so that what is made of them stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def schema_of(*fields: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])

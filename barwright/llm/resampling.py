"""Importance resampling towards a target distribution.

Two passes over the texts in Arrow batches. The first counts hashed features: every partition gives one vector by
``np.bincount`` and ``treeReduce`` adds the vectors. The second sends each bucket's gain (how much commoner it is in the
target) to the tasks and sums it over each document with ``np.bincount``'s weights. A document's score is its weight plus
Gumbel noise from its id; the highest scores are a draw without replacement in proportion to the exponentiated weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import chunks, small_batches, written


@dataclass(frozen=True)
class Resampling:
    """buckets: of the hashed features. words: features are runs of 1 to so many words. percent: of the documents with
    ``least_words`` that are drawn. seed: of the noise. scale: gains and noise are floors of so many times logarithms."""

    buckets: int = 10_000
    words: int = 1
    percent: int = 10
    least_words: int = 20
    seed: int = 2024
    scale: int = 1000


#: A-Z become a-z; other ASCII characters but digits and letters become blanks.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of a text that are split into words at once.
_PART = 1 << 20


class _Buckets(dict):
    """Buckets of features, remembered up to a bound."""

    LIMIT = 1 << 16

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        b = self[feature] = zlib.crc32(feature) % self.buckets
        return b

    def of(self, features: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, features), dtype=np.int64, count=len(features))


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The text's words, in lists from about a megabyte of text each."""
    data, at = text.encode("utf-8", "replace").translate(_PLAIN) if text else b"", 0
    while at < len(data):
        end = data.find(b" ", at + _PART)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _features(text: str | None, c: Resampling, known: _Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and the buckets of all features, part by part."""
    last: list[bytes] = []
    for words in words_of(text):
        found = [known.of(words)]
        joined = last + words
        for n in range(2, c.words + 1):
            first = max(0, len(last) - n + 1)
            found.append(known.of([b" ".join(joined[i : i + n]) for i in range(first, len(joined) - n + 1)]))
        last = joined[len(joined) - c.words + 1 :] if c.words > 1 else []
        yield len(words), np.concatenate(found)


def bucket_counts(texts: DataFrame, c: Resampling = Resampling()) -> np.ndarray:
    """How often the features of each bucket occur in all rows of the column ``text``. Null and empty texts have none;
    repeated rows count again; no rows give zeros."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(c.buckets), np.zeros(c.buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                for _, found in _features(text.as_py(), c, known):
                    total += np.bincount(found, minlength=c.buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(F.col("text").cast("string")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    if vectors.getNumPartitions() == 0:
        return np.zeros(c.buckets, np.int64)
    return vectors.treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray, c: Resampling = Resampling()) -> np.ndarray:
    """Each bucket's floored log ratio of its smoothed shares in the target and in the source."""
    s_all, t_all = float(source.sum() + c.buckets), float(target.sum() + c.buckets)
    return np.array([math.floor(c.scale * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.float64)


def weights(docs: DataFrame, gain: np.ndarray, c: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of the features' gains) of each document."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(c.buckets)
        for b in chunks(batches, 256):
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            held, of, many = [], [], 0

            def add() -> None:
                if held:
                    row, bucket = np.repeat(of, [len(x) for x in held]), np.concatenate(held)
                    weight[:] += np.bincount(row, weights=sent.value[bucket], minlength=b.num_rows).astype(np.int64)

            for i, text in enumerate(b.column(1)):
                for n, found in _features(text.as_py(), c, known):
                    n_words[i] += n
                    n_features[i] += len(found)
                    held.append(found)
                    of.append(i)
                    many += len(found)
                    if many > 1 << 20:
                        add()
                        held, of, many = [], [], 0
            add()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """The rows with ``rank``, their place from 1 in that order over all partitions: a sort by ranges, places within
    each range, and the ranges' offsets, one row a range."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at + 1, at + n + 1))], [*b.schema.names, "part", "nth"])
            at += n

    shape = T.StructType([*rows.schema, T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, shape), "ranked")
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.groupBy("part").agg(F.max("nth").alias("n")).select("part", before.alias("before"))
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def resampled(docs: DataFrame, target: DataFrame, c: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Null and empty texts have no features and weight 0. Ties of scores go to the smaller doc_id, null ids last; rows that
    repeat a doc_id are told apart by their place in the table. A null doc_id's noise is that of an empty id. Without
    documents there are no rows; an empty target only smooths.
    """
    gain = gains(bucket_counts(docs, c), bucket_counts(target, c), c)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{c.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-float(c.scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weights(docs, gain, c).withColumn("score", F.col("weight") + noise).withColumn("place", F.monotonically_increasing_id())
    scored = written(scored, "scored")
    enough = F.col("n_words") >= c.least_words
    drawn = c.percent * scored.where(enough).count() // 100
    ranked = numbered(scored.where(enough).select("doc_id", "n_features", "weight", "score", "place"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(names).unionByName(rest.select(names))


def sql(c: Resampling = Resampling()) -> str:
    """The query's result for features of one word and unique doc_ids, in SQL; crc32 is worked out bit by bit for each
    distinct word."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    bit = "lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END"
    return f"""
WITH d AS (SELECT doc_id, {words} AS ws FROM documents),
o AS (SELECT doc_id, unnest(ws) AS word FROM d),
g AS (SELECT unnest({words}) AS word FROM benchmark),
u AS (SELECT word, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT word, 1 AS s, 0 AS t FROM o UNION ALL SELECT word, 0, 1 FROM g) GROUP BY word),
x AS (SELECT *, hex(encode(word)) AS hx FROM u),
y AS (SELECT word, s, t, list_transform(range(len(hx) // 2), lambda i: ('0x' || hx[2 * i + 1:2 * i + 2])::BIGINT) AS bs FROM x),
k AS (SELECT word, s, t, xor(list_reduce(bs, lambda a, b: list_reduce(range(8), {bit}, xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT) % {c.buckets} AS bucket FROM y),
b AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM k GROUP BY bucket),
a AS (SELECT sum(s) + {c.buckets} AS sa, sum(t) + {c.buckets} AS ta FROM b),
f AS (SELECT bucket, floor({c.scale} * ln(((t + 1)::DOUBLE * sa::DOUBLE) / ((s + 1)::DOUBLE * ta::DOUBLE)))::BIGINT AS gain FROM b, a),
w AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM o JOIN k USING (word) JOIN f USING (bucket) GROUP BY doc_id),
h AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || sha256('{c.seed}:' || doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, n_features, weight, weight + floor(-{c.scale} * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {c.least_words} ORDER BY score DESC, doc_id) AS nth, count(*) OVER (PARTITION BY n_features >= {c.least_words}) AS many FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {c.least_words} AND nth <= {c.percent} * many // 100 THEN nth END AS rank FROM p"""

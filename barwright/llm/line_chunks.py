"""Line deduplication by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of two lines chooses where chunks end, so a boundary depends on the lines beside it and
not on what stands further up: an insertion shifts no later boundary. A chunk of several lines that occurs elsewhere,
byte by byte, is removed but for its first occurrence (least doc_id, then text, then place).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_row, written


@dataclass(frozen=True)
class LineChunks:
    """every: a boundary comes after one line in so many, on average. least_lines: shorter chunks are never removed.
    broadcast_hashes, broadcast_docs: tables of up to so many hashes or documents are sent to all executors instead of
    shuffling texts; larger ones are joined by a shuffle."""

    every: int = 3
    least_lines: int = 2
    broadcast_hashes: int = 1_000_000
    broadcast_docs: int = 250_000


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _chunked(docs: DataFrame, c: LineChunks) -> DataFrame:
    """Adds ``lines`` and ``cuts``: the number of the last line of each chunk. A null text has no lines."""
    rows = docs.withColumn("lines", F.coalesce(F.split("text", "\n", -1), F.array().cast("array<string>")))
    rows = rows.withColumn("hashes", F.transform("lines", _line_hash))
    rolled = F.zip_with("hashes", F.slice(F.concat(F.array(F.lit(0).cast("long")), F.col("hashes")), 1, F.size("hashes")), lambda h, before: h + before * 31)
    ends = F.transform(rolled, lambda r, i: F.when((r % c.every == 0) | (i + 1 == F.size("lines")), i + 1))
    return rows.withColumn("cuts", F.array_compact(ends)).drop("hashes")


def _span(j: Column) -> tuple[Column, Column]:
    """First line, counted from 1, and number of lines of the j-th chunk, counted from 1."""
    first = F.when(j > 1, F.element_at("cuts", F.greatest(j - 1, F.lit(1)))).otherwise(0) + 1
    return first, F.element_at("cuts", j) - first + 1


def chunk_rows(docs: DataFrame, c: LineChunks) -> DataFrame:
    """doc_id, text_key, chunk (its number) and the text of every chunk that is long enough to be removed."""
    rows = _chunked(docs, c).where(F.size("cuts") > 0)
    rows = rows.select("doc_id", "text_key", "lines", "cuts", F.explode(F.sequence(F.lit(1), F.size("cuts"))).alias("chunk"))
    first, many = _span(F.col("chunk"))
    return rows.where(many >= c.least_lines).select("doc_id", "text_key", "chunk", F.array_join(F.slice("lines", first, many), "\n").alias("content"))


def _sent_if_few(df: DataFrame, most: int) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


ADDED = ("kept_text", "n_lines", "n_chunks", "removed_chunks", "removed_lines")


def _deduplicated(docs: DataFrame, c: LineChunks) -> DataFrame:
    """The row as a struct ``__row`` and the added columns."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    chunks = chunk_rows(keyed, c)
    often = chunks.select("doc_id", "text_key", "chunk", F.xxhash64("content").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    often = written(often.select("hash"), "hashes")
    again = written(chunks.withColumn("hash", F.xxhash64("content")).join(_sent_if_few(often, c.broadcast_hashes), "hash").drop("hash"), "repeated")
    place = F.struct("doc_id", "text_key", "chunk")
    first = again.groupBy("content").agg(F.min(place).alias("first"), F.max(place).alias("last"))  # the bytes themselves are compared
    gone = again.join(first.where("not first <=> last"), "content").where(~place.eqNullSafe(F.col("first")))
    gone = written(gone.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set("chunk").alias("__gone")), "gone")
    rows = docs.select(whole_row(docs).alias("__row"), doc_id.alias("__doc"), text.alias("text"), F.xxhash64(text).alias("__k"))
    rows = rows.join(_sent_if_few(gone, c.broadcast_docs), F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key")), "left")
    split = _chunked(rows.select("__row", "text", F.coalesce("__gone", F.array().cast("array<int>")).alias("__gone")), c)
    split = split.withColumn("kept", F.filter(F.sequence(F.lit(0), F.size("cuts")), lambda j: (j > 0) & ~F.array_contains("__gone", j)))

    def content(j: Column) -> Column:
        first, many = _span(j)
        return F.array_join(F.slice("lines", first, many), "\n")

    def lines(j: Column) -> Column:
        return _span(j)[1].cast("long")

    kept = F.when(F.size("__gone") == 0, F.col("text")).otherwise(F.array_join(F.transform("kept", content), "\n"))
    lost = F.aggregate("__gone", F.lit(0).cast("long"), lambda n, j: n + lines(j))
    return split.select("__row", kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.size("cuts").cast("long").alias("n_chunks"), F.size("__gone").cast("long").alias("removed_chunks"), lost.alias("removed_lines"))


def line_dedup(docs: DataFrame, c: LineChunks = LineChunks()) -> DataFrame:
    """docs with ``kept_text`` and the counts n_lines, n_chunks, removed_chunks, removed_lines beside its columns.

    docs has doc_id and text; its columns of the added names are replaced. A null text stays null and an empty text is
    one empty line. Rows with the same doc_id and text are one document: they keep and lose the same chunks. Null
    doc_ids come first. A text that loses all chunks becomes empty; the row stays. An empty table stays empty.
    """
    rows = _deduplicated(docs, c)
    return rows.select(*[F.col("__row")[x].alias(x) for x in docs.columns if x not in ADDED], *ADDED)


def without_repeats(docs: DataFrame, c: LineChunks = LineChunks()) -> DataFrame:
    """docs, its columns unchanged in number and order, with repeated chunks removed from text and n_chars set anew."""
    kept = F.col("kept_text")
    anew = {"text": kept} | ({"n_chars": F.length(kept).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return _deduplicated(docs, c).select(*[anew.get(x, F.col("__row")[x]).alias(x) for x in docs.columns])


def sql(c: LineChunks = LineChunks()) -> str:
    """The query's result for a table with unique doc_ids, in SQL."""
    return f"""
WITH l AS (SELECT doc_id, text, coalesce(string_split(text, chr(10)), []) AS lines FROM documents),
h AS (SELECT *, list_transform(lines, lambda x: ('0x' || md5(x)[1:8])::BIGINT) AS hs FROM l),
k AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines) OR (hs[i] + 31 * CASE WHEN i > 1 THEN hs[i - 1] ELSE 0 END) % {c.every} = 0) AS cuts FROM h),
e AS (SELECT doc_id, lines, cuts, unnest(range(1, len(cuts) + 1)) AS chunk FROM k),
p AS (SELECT doc_id, chunk, CASE WHEN chunk > 1 THEN cuts[chunk - 1] ELSE 0 END AS before, cuts[chunk] AS upto, lines FROM e),
t AS (SELECT doc_id, chunk, upto - before AS many, array_to_string(lines[before + 1:upto], chr(10)) AS content FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY content, many >= {c.least_lines} ORDER BY doc_id, chunk) AS nth FROM t),
s AS (SELECT doc_id, string_agg(content, chr(10) ORDER BY chunk) FILTER (many < {c.least_lines} OR nth = 1) AS kept,
      count(*) AS n_chunks, sum(many) AS n_lines, count(*) FILTER (many >= {c.least_lines} AND nth > 1) AS removed_chunks,
      coalesce(sum(many) FILTER (many >= {c.least_lines} AND nth > 1), 0) AS removed_lines FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_chunks, 0)::BIGINT AS n_chunks,
  coalesce(removed_chunks, 0)::BIGINT AS removed_chunks, coalesce(removed_lines, 0)::BIGINT AS removed_lines,
  length(CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END)::BIGINT AS kept_chars,
  md5(CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END) AS kept_md5
FROM documents d LEFT JOIN s USING (doc_id)"""

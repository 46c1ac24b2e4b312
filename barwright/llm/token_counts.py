"""Token counts of whole texts, huge ones in overlapping chunks that are spliced where they agree.

A text up to the chunk size is encoded at once. A longer one is cut into chunks that overlap, and the chunks of all long
texts are dealt to tasks evenly. Where two neighbours' encodings both have the token x end and the token y begin at the
same byte, the first one's tokens up to x and the second one's from y on are the encoding of the whole: merges are chosen
by rank, then from the left, so a list of tokens is the encoding of its text exactly if every two adjacent tokens are the
encoding of theirs, and each adjacent pair of the spliced list is adjacent in one chunk's encoding. If an overlap has no
such place, the text is cut again with wider overlaps at other places, and at last encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, written


@dataclass(frozen=True)
class TokenCounts:
    """model: a sentencepiece file. chunk: characters that are encoded at once. overlap: characters of a chunk that the
    next one holds too; ``widen`` times as many in each further round, ``rounds`` rounds in all. limit: of over_limit."""

    model: str
    chunk: int = 16_384
    overlap: int = 256
    widen: int = 4
    rounds: int = 3
    limit: int = 4096


#: Bits of a mark for each of the two tokens; the rest is the place in bytes.
_BITS = 22


class Pieces:
    """A sentencepiece model with the lengths of its pieces in the UTF-8 of normalised text, where a blank is U+2581."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto, TrainerSpec

        self.sp = SentencePieceProcessor(model_file=path)
        n = self.sp.vocab_size()
        self.lengths = np.array([1 if self.sp.is_byte(i) else len(self.sp.id_to_piece(i).encode()) for i in range(n)], np.int64)
        self.unknown = self.sp.unk_id()
        proto = ModelProto.FromString(self.sp.serialized_model_proto())
        norm, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        kind = ModelProto.SentencePiece
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        #: Whether splices are proven: merges by rank over unchanged text, no pieces that are taken apart or matched first.
        self.spliceable = bool(plain and proto.trainer_spec.model_type == TrainerSpec.BPE and not proto.trainer_spec.treat_whitespace_as_suffix and not kinds & {kind.UNUSED, kind.USER_DEFINED} and n < 1 << _BITS)

    def counts(self, texts: list[str | None]) -> list[int]:
        return [len(x) for x in self.sp.encode([t or "" for t in texts], num_threads=1)]

    def marks(self, chunk: str, ids: list[int], overlap: int, ends: bool) -> tuple[list[int], list[int]]:
        """The places in the first or last ``overlap`` characters where a token ends and one begins: each with the bytes
        from there to the overlap's end and both ids in one number, and the number of tokens before."""
        size = lambda t: len(t.replace(" ", "▁").encode())
        ids = np.array(ids, np.int64)
        at = np.cumsum(self.lengths[ids])
        if len(ids) < 2 or (ids == self.unknown).any() or at[-1] != 3 + size(chunk):
            return [], []
        most = size(chunk[len(chunk) - overlap :] if ends else chunk[:overlap])
        left = (at[-1] if ends else most + 3) - at[:-1]
        found = np.flatnonzero((left > 0) & (left < most))
        return ((left[found] << (2 * _BITS)) | (ids[found] << _BITS) | ids[found + 1]).tolist(), (found + 1).tolist()


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _cut(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """digest, n_chunks, chunk and piece: the overlapping chunks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for digest, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                n = max(1, -(-(len(text) - overlap) // chunk))  # the last one is longer than an overlap
                for at in range(0, n, 64):
                    which = range(at, min(n, at + 64))
                    cut = [text[i * chunk : (i + 1) * chunk + overlap if i + 1 < n else None] for i in which]
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(cut)), pa.array([n] * len(cut), pa.int32()), pa.array(which, pa.int32()), pa.array(cut)], ["digest", "n_chunks", "chunk", "piece"])

    return texts.select("digest", "text").mapInArrow(run, "digest string, n_chunks int, chunk int, piece string")


_MARKS = "struct<marks: array<long>, before: array<long>>"


def _spliced(texts: DataFrame, c: TokenCounts, chunk: int, overlap: int) -> DataFrame:
    """digest and n_tokens of each different text; null where an overlap has no common place."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(c.model)
        shape = pa.struct([("marks", pa.list_(pa.int64())), ("before", pa.list_(pa.int64()))])
        for b in chunks(batches, 64):
            out = []
            texts = b.column(3).to_pylist()
            for digest, n, i, text, ids in zip(*(b.column(x).to_pylist() for x in range(3)), texts, model.sp.encode(texts, num_threads=1), strict=True):
                named = lambda x: dict(zip(("marks", "before"), x, strict=True))
                if i:
                    out.append((digest, n, i - 1, None, named(model.marks(text, ids, overlap, False)), None))
                out.append((digest, n, i, named(model.marks(text, ids, overlap, True)), None, None) if i + 1 < n else (digest, n, i, None, None, len(ids)))
            columns = list(zip(*out, strict=True))
            kinds = [pa.string(), pa.int32(), pa.int32(), shape, shape, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["digest", "n_chunks", "edge", "a", "b", "tail"])

    dealt = _cut(texts, chunk, overlap).hint("rebalance")
    edges = dealt.mapInArrow(encode, f"digest string, n_chunks int, edge int, a {_MARKS}, b {_MARKS}, tail long")
    # Copies of a text give equal rows, of which one counts.
    edges = edges.groupBy("digest", "n_chunks", "edge").agg(*[F.first(x, ignorenulls=True).alias(x) for x in ("a", "b", "tail")])
    common = F.array_intersect("a.marks", "b.marks")
    edges = edges.withColumn("mark", F.when(F.size(common) > 0, F.element_at(common, F.greatest(F.size(common) / 2, F.lit(1)).cast("int"))))
    before = lambda x: F.element_at(f"{x}.before", F.array_position(F.col(f"{x}.marks"), F.col("mark")).cast("int"))
    edges = edges.withColumn("n", F.coalesce("tail", F.when(F.col("mark").isNotNull(), before("a") - before("b"))))
    sums = edges.groupBy("digest").agg(F.sum("n").alias("n_tokens"), F.count("n").alias("known"), F.max("n_chunks").alias("n_chunks"))
    return sums.select("digest", F.when(F.col("known") == F.col("n_chunks"), F.col("n_tokens")).alias("n_tokens"))


def token_counts(docs: DataFrame, c: TokenCounts) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document's whole text.

    A null text is empty and has 0 bytes and tokens. Repeated rows give equal rows; a null doc_id stays null; other
    columns are ignored; an empty table gives none. With a model whose splices aren't proven, every text is encoded whole.
    """
    if 4 * c.overlap * (c.widen + 1) ** c.rounds >= 1 << (63 - 2 * _BITS):
        raise ValueError("overlaps are too wide for the places of marks")
    small_batches(docs.sparkSession)
    spliceable = pieces(c.model).spliceable
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    huge = (F.length("text") > c.chunk) if spliceable else F.lit(False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(c.model)
        for b in chunks(batches, 128):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(_counted(model, b.column(3).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "digest", "n_tokens"])

    short = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.when(huge, F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.when(~huge, F.col("text")).alias("text"))
    counted = written(short.mapInArrow(count, "doc_id long, n_bytes long, digest string, n_tokens long"), "counted")
    over = (F.col("n_tokens") > c.limit).alias("over_limit")
    if counted.where("digest is not null").isEmpty():
        return counted.select("doc_id", "n_bytes", "n_tokens", over)

    texts = rows.where(huge).select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")
    totals, left, chunk, overlap = [], texts, c.chunk, c.overlap
    for _ in range(c.rounds):
        found = written(_spliced(left, c, chunk, overlap), "spliced")
        totals.append(found.where("n_tokens is not null"))
        open_ = found.where("n_tokens is null").select("digest")
        if open_.isEmpty():
            break
        left = texts.join(open_, "digest", "left_semi")
        overlap = overlap * c.widen + 1  # odd, so that periodic texts are cut in another phase
        chunk = max(c.chunk, 4 * overlap) + 1
    else:
        whole = left.dropDuplicates(["digest"]).select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_bytes"), "digest", "text")
        totals.append(written(whole.mapInArrow(count, "doc_id long, n_bytes long, digest string, n_tokens long").select("digest", "n_tokens"), "whole"))
    known = totals[0]
    for more in totals[1:]:
        known = known.unionByName(more)
    joined = counted.where("digest is not null").drop("n_tokens").join(known, "digest")
    names = ["doc_id", "n_bytes", "n_tokens", over]
    return counted.where("digest is null").select(names).unionByName(joined.select(names))


def _counted(model: Pieces, texts: list[str | None]) -> list[int | None]:
    """Counts of the texts; null for null."""
    own = iter(model.counts([t for t in texts if t is not None]))
    return [None if t is None else next(own) for t in texts]

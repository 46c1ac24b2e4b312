"""Toxicity by class-conditional Kneser-Ney models.

For each class the model keeps, as Kneser-Ney's lower order does, in how many different contexts (words before it) a
word occurs in texts of that class. So a phrase that is copied or repeated counts once. A class's probability of a word
is its discounted share of contexts plus backoff mass times the share of contexts in both classes together. The backoff
mass is the same in both classes. Discounts come from counts of counts and lie under one, so that a word's contexts
count however few they are beside the input. The score compares the length-normalised log-likelihoods of a text under
the two models: over the whole text and over its strongest words.

Weights of the score are fitted on a bounded sample of training texts, each scored without the contexts that it alone
has: what other texts of its class hold too stays, as it does for texts that come later.

Words are hashed into cells, whose number grows with the training text up to a bound, so that the model can be sent to
all executors. Counts cover all labelled training rows.
(With a bigram level on top, held-out accuracy fell: most bigrams of a text occur nowhere else.)
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, chunks, lower_words, small_batches, written


@dataclass(frozen=True)
class Toxicity:
    """cells, most_cells: of the hashed vocabulary, one per ``chars`` characters of training text, a power of two between
    the two. discount: of a class's counts where its counts of counts give none. sample:
    training rows at most that fit the five weights of the final logistic step (counts use all). broadcast_labels: up to
    so many labels are sent to all executors, more are shuffled."""

    cells: int = 1 << 20
    most_cells: int = 1 << 23
    chars: int = 256
    discount: float = 0.75
    sample: int = 20_000
    broadcast_labels: int = 2_000_000


_MARKS = b".,;:!?\"'()[]{}<>*#%$&@^_=+~`|/\\-"


class _Hashes(WordHashes):
    """Hashes of words without the ASCII marks around them."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.strip(_MARKS) or word)
        return h


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text divides by 5; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _labelled(docs: DataFrame, labels: DataFrame, c: Toxicity) -> DataFrame:
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = written(marks.where("toxic in (0, 1)"), "labels")
    few = marks.limit(c.broadcast_labels + 1).count() <= c.broadcast_labels
    return docs.join(F.broadcast(marks) if few else marks, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic")


class _Tables:
    """Contexts by class, and the figures that give both classes one backoff mass over one shared backoff distribution.

    Workers hold the counts alone: what a word's probability needs beside them are five figures.
    """

    def __init__(self, contexts: np.ndarray, discount: tuple[float, float]):
        total = np.maximum(contexts.sum(1, dtype=np.float64), 1)
        kept = np.array([sum(np.maximum(x - np.float32(d), 0).sum(dtype=np.float64) for x in np.array_split(row, 64)) for row, d in zip(contexts, discount, strict=True)]) / total
        self.contexts, self.discount = contexts, np.array(discount)
        self.backoff = (1 - kept.min()) / (contexts.sum(dtype=np.float64) + contexts.shape[1] / 2)
        self.factor = np.where(kept > 0, kept.min() / np.maximum(kept, 1e-12), 0) / total


@dataclass(frozen=True)
class Model:
    """tables: contexts of each cell by class. weights: of the logistic step on standardised features. share: of label 1."""

    tables: _Tables
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    share: float

    @property
    def discount(self) -> np.ndarray:
        return self.tables.discount


FEATURES = 5
#: Bits of the word before, beside 25 for the class and the cell.
BEFORE = 38


def _discount(contexts: np.ndarray, otherwise: float) -> float:
    """Kneser-Ney's discount of a class, from how many words have one context and how many have two. It lies under 1
    whatever the size of the input, so a single context still counts."""
    once, twice = int(np.count_nonzero(contexts == 1)), int(np.count_nonzero(contexts == 2))
    return once / (once + 2 * twice) if once and twice else otherwise


def _features(h: np.ndarray, t: _Tables, own: tuple[int, np.ndarray, np.ndarray] | None = None) -> list[float]:
    """Length-normalised log-likelihood ratios of a text. ``own``: its class, and the cells (ascending) and numbers of the
    contexts that no other text of the class has, which are left out."""
    cells = t.contexts.shape[1]
    cell = (h & np.uint64(cells - 1)).astype(np.int64)
    n = t.contexts[:, cell].astype(np.float64)
    backoff = t.backoff * (n.sum(0) + 0.5)
    if own is not None and len(own[1]):
        label, at, many = own
        place = np.minimum(np.searchsorted(at, cell), len(at) - 1)
        n[label] = np.maximum(n[label] - np.where(at[place] == cell, many[place], 0), 0)
    p = np.maximum(n - t.discount[:, None], 0) * t.factor[:, None] + backoff
    ratio = np.log(p[1] / p[0])
    m = len(ratio)
    top = np.sort(ratio[np.argpartition(ratio, m - 3)[-3:]]) if m > 3 else np.sort(np.concatenate([np.zeros(3 - m), ratio]))
    return [ratio.mean(), top[-1], top.mean(), math.sqrt(np.maximum(ratio - 1.5, 0).mean()), math.log1p(m)]


def _keys(h: np.ndarray, label: int, cells: int) -> np.ndarray:
    """The class, the word's cell and some bits of the word before it, in one integer."""
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BEFORE)
    return (before | ((h & np.uint64(cells - 1)) + np.uint64(label * cells)) << np.uint64(BEFORE)).view(np.int64)


def train(docs: DataFrame, labels: DataFrame, c: Toxicity = Toxicity()) -> Model:
    """Learns from the documents that labels mark 0 or 1 and that aren't held out."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _labelled(docs, labels, c).where(~held_out(F.col("doc_id")))
    told = {r.toxic: r for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    ones, zeros = (told[y].n if y in told else 0 for y in (1, 0))
    chars = sum(r.chars or 0 for r in told.values())
    cells = min(c.most_cells, max(c.cells, 1 << math.ceil(math.log2(max(1, chars / c.chars)))))

    # Texts that fit the logistic step are told apart by their hash; all others are 0. Copies of a text are one text.
    drawn = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 20)) < F.lit(int(min(1.0, c.sample / max(1, ones + zeros)) * (1 << 20)))
    rows = rows.where("text is not null").withColumn("who", F.when(drawn, F.xxhash64("text")).otherwise(F.lit(0)))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in chunks(batches):
            found = {}
            for text, y, who in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if w := lower_words(text):
                    found.setdefault(who, []).append(_keys(hashes.of(w), y, cells))
            for who, keys in found.items():
                keys = np.unique(np.concatenate(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), who))], ["context", "who"])

    cell = F.shiftrightunsigned("context", BEFORE)
    seen = rows.select("text", "toxic", "who").mapInArrow(contexts, "context long, who long")
    seen = seen.groupBy("context").agg(F.min("who").alias("low"), F.max("who").alias("high"))
    alone = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0).alias("who")  # the one text that has the context
    sums = written(seen.groupBy(cell.alias("cell"), alone).agg(F.count("*").alias("n")), "contexts")
    table = np.zeros((2, cells), np.float32)
    told = sums.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # two rows a cell at most
    at, n = told.column("cell").to_numpy(), told.column("n").to_numpy()
    table[at // cells, at % cells] = n
    share = ones / (ones + zeros) if ones + zeros else 0.0
    tables = _Tables(table, tuple(_discount(row, c.discount) for row in table))
    flat = Model(tables, np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES), share)
    if not ones or not zeros:
        return flat

    shared = spark.sparkContext.broadcast(tables)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in chunks(batches):
            out = []
            for text, y, at, many in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if w := lower_words(text):
                    at = np.array(at or [], np.int64)
                    order = np.argsort(at)
                    out.append((y, _features(hashes.of(w), shared.value, (y, at[order], np.array(many or [], np.float64)[order]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in out], pa.int32()), pa.array([x for _, x in out], pa.list_(pa.float64()))], ["toxic", "x"])

    own = sums.where("who != 0").groupBy("who", F.shiftright("cell", cells.bit_length() - 1).cast("int").alias("toxic"))  # drawn texts alone
    own = own.agg(F.collect_list(F.col("cell").bitwiseAND(F.lit(cells - 1))).alias("at"), F.collect_list("n").alias("many"))
    chosen = rows.where("who != 0").dropDuplicates(["who", "toxic"]).join(own, ["who", "toxic"], "left").select("text", "toxic", "at", "many")
    got = chosen.mapInArrow(features, "toxic int, x array<double>").toArrow()
    shared.destroy()
    y = got.column("toxic").to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        return flat
    x = np.array(got.column("x").to_pylist())
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    return Model(tables, _logistic((x - centre) / scale, y), centre, scale, share)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton's method, the constant first."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class _Scorer:
    """Scores texts; made once per task or Python worker."""

    def __init__(self, model: Model, c: Toxicity):
        self.m, self.hashes, self.ready = model, _Hashes(), model.weights.any()

    def __call__(self, text: str | None) -> float:
        words = lower_words(text) if self.ready else None
        if not words:
            return self.m.share
        x = (np.array(_features(self.hashes.of(words), self.m.tables)) - self.m.centre) / self.m.scale
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.m.weights[0] + self.m.weights[1:] @ x))))


def score(docs: DataFrame, model: Model, c: Toxicity = Toxicity()) -> DataFrame:
    """doc_id and score per document.

    A text without words, or a model that has not seen both labels, gives the share of label 1. Repeated rows get equal
    scores; a null doc_id stays null; other columns of docs are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value, c)
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, labels: DataFrame, c: Toxicity = Toxicity()) -> DataFrame:
    """The documents, with all their columns, that score under one half. Null, empty and wordless texts score the share of
    label 1 and so stay unless most labelled rows are toxic; repeated rows stay or go together; a null doc_id is no
    obstacle; a table without labels of both kinds, or without rows, stays as it is where that share is under one half."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, c))

    def stays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _Scorer(shared.value, c)
        for texts in batches:
            parts = (texts.slice(i, 512).to_pylist() for i in range(0, len(texts), 512))
            yield pa.array([scorer(t) < 0.5 for part in parts for t in part], pa.bool_())

    return docs.where(F.arrow_udf(stays, "boolean")(F.col("text").cast("string")))

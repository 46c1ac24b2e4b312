"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

In each epoch a hash puts a source's documents in random order, and ranges of that hash are its blocks. A target draws
permuted blocks without replacement, first those of the first epoch, until its words are reached; the last block is
drawn in part. The tree parts the exact number of drawn blocks of every source and epoch among output shards: at each
node the blocks that go left are one multivariate hypergeometric draw. Shards take disjoint runs of the permuted blocks
and order their documents by another hash. A document is taken as often as a block that holds it is drawn.

Blocks grow in size and not in number beyond a bound, so their table is small whatever the input. A document's blocks
follow from its own row, so texts are moved once, into their shards.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, whole_row, word_count, written


@dataclass(frozen=True)
class Mixing:
    """weights: of sources by code point, null last, repeating. share: words of the mix per word of all sources.
    most: targets stop at so many times their source's words, one epoch each. block: words of a block, fewer where a source
    would have less than ``each`` blocks, more where ``blocks`` of them would not hold all epochs. shard: words of an output
    shard, fewer where there would be less than ``least_shards``, more where ``shards`` are not enough or where the quotas
    of all shards, sources and epochs would be over ``quotas`` numbers.
    part: words of a shard that are ordered together."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    block: int = 1 << 15
    blocks: int = 1 << 18
    each: int = 64
    shard: int = 1 << 20
    least_shards: int = 4
    quotas: int = 1 << 24
    shards: int = 4096
    part: int = 1 << 24
    seed: int = 20


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is cut off is shared by weight again."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / w > most * sizes[i]}
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else rest * weights[i] / w
        rest -= sum(out[i] for i in over)
        open_ = open_ - over if over else set()
    return out


def split_tree(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas [shard, source] that sum to ``blocks``: halves of the shards part their node's blocks by a draw."""
    out = np.zeros((shards, len(blocks)), np.int64)

    def part(lo: int, hi: int, here: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = here
            return
        mid = (lo + hi) // 2
        total = int(here.sum())
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(here, total * (mid - lo) // (hi - lo), method="marginals") if total else here
        part(lo, mid, left)
        part(mid, hi, here - left)

    part(0, shards, blocks.astype(np.int64))
    return out


def _sized(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    size = word_count(text).alias("size")
    key = F.xxhash64(text).alias("text_key")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, F.col("source").cast("string").alias("source"), size)


SOURCES = "sid int, source string, source_size long, target double, goal long, bits int"


def _sources(sized: DataFrame, c: Mixing) -> DataFrame:
    """One row per source: its size, target and number of blocks, a power of two. Only this table of sources passes the
    driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r["size"]) for r in rows]
    weights = [float(c.weights[i % len(c.weights)]) for i in range(len(rows))]
    goal = targets(sizes, weights, c.share * sum(sizes), c.most)
    block = max(c.block, 2 * c.most * sum(sizes) // c.blocks)
    least = min(c.each, c.blocks // (2 * c.most * max(1, len(sizes))))
    bits = [max(0, math.ceil(math.log2(max(1, n / block))), min(n, least).bit_length() - 1) for n in sizes]
    out = [(i, r.source, sizes[i], goal[i], min(round(goal[i]), c.most * sizes[i]), bits[i]) for i, r in enumerate(rows)]
    return written(sized.sparkSession.createDataFrame(out, T._parse_datatype_string(SOURCES)).coalesce(1), "sources")


def _place(epoch: int, c: Mixing) -> tuple[Column, Column]:
    """A row's place in its source's order in an epoch: 63 bits, then more bits for ties."""
    first, then = (F.xxhash64("doc_id", "text_key", F.lit(c.seed), F.lit(epoch), F.lit(x)) for x in (0, 1))
    return F.shiftrightunsigned(first, 1), then


def _block(place: Column) -> Column:
    return F.call_function("shiftright", place, F.lit(63) - F.col("bits"))


BLOCKS = "sid int, epoch int, block long, shard int, rest long"


def _drawn(rows: DataFrame, sources: DataFrame, c: Mixing) -> tuple[DataFrame, int]:
    """The drawn blocks with their shards, and the number of parts of a shard. ``rest`` is the number of words that a
    block drawn in part gives. Sums of blocks pass the driver, at most ``blocks`` and one per source and epoch."""
    marked = [rows.select("sid", F.lit(e).alias("epoch"), _block(_place(e, c)[0]).alias("block"), "size") for e in range(c.most)]
    every = marked[0]
    for x in marked[1:]:
        every = every.union(x)
    sums = every.where("size > 0").groupBy("sid", "epoch", "block").agg(F.sum("size").alias("n")).orderBy("sid", "epoch", "block").toArrow()
    sid, epoch, block, n = (sums.column(x).to_numpy() for x in ("sid", "epoch", "block", "n"))
    goals = {r.sid: r.goal for r in sources.select("sid", "goal").collect()}
    total = sum(goals.values())
    many = len(np.unique(sid * c.most + epoch)) if len(sid) else 1
    shards = max(1, min(c.shards, max(c.least_shards, -(-total // c.shard)), c.quotas // max(1, many)))
    strata, left = [], dict(goals)
    for key in sorted(set(zip(sid.tolist(), epoch.tolist(), strict=True))):
        here = np.flatnonzero((sid == key[0]) & (epoch == key[1]))
        here = here[np.random.default_rng([c.seed, *key]).permutation(len(here))]
        ahead = np.cumsum(n[here]) - n[here]
        here, ahead = here[ahead < left[key[0]]], ahead[ahead < left[key[0]]]
        if len(here):
            rest = min(int(n[here[-1]]), left[key[0]] - int(ahead[-1]))
            strata.append((key, here, rest if rest < n[here[-1]] else None))
            left[key[0]] -= int(ahead[-1]) + rest
    quotas = split_tree(np.array([len(here) for _, here, _ in strata], np.int64), shards, c.seed)
    out = []
    for i, (key, here, rest) in enumerate(strata):
        shard = np.repeat(np.arange(shards), quotas[:, i]).tolist()
        out += [(*key, int(block[x]), s, rest if x == here[-1] else None) for x, s in zip(here, shard, strict=True)]
    table = rows.sparkSession.createDataFrame(out, T._parse_datatype_string(BLOCKS))
    return written(table.coalesce(1), "blocks"), max(1, -(-total // shards // c.part))


def _cuts(rows: DataFrame, blocks: DataFrame, c: Mixing) -> DataFrame:
    """(sid, epoch, at, then, words): where a block drawn in part ends, one row per source and epoch at most. Rows equal
    in doc_id and text share what is left there, whole words each."""
    parts = F.broadcast(blocks.where("rest is not null").select("sid", "epoch", "block", "rest"))
    found = None
    for e in range(c.most):
        at, then = _place(e, c)
        here = rows.where("size > 0").select("sid", F.lit(e).alias("epoch"), _block(at).alias("block"), at.alias("at"), then.alias("then"), "size")
        here = here.join(parts, ["sid", "epoch", "block"])
        found = here if found is None else found.union(here)
    once = found.groupBy("sid", "epoch", "at", "then", "rest").agg(F.count("*").alias("rows"), F.max("size").alias("size"))
    before = W.partitionBy("sid", "epoch").orderBy("at", "then").rowsBetween(W.unboundedPreceding, -1)
    once = once.withColumn("ahead", F.coalesce(F.sum(F.col("rows") * F.col("size")).over(before), F.lit(0)))
    ends = once.where("ahead < rest and ahead + rows * size >= rest")
    return written(ends.select("sid", "epoch", "at", "then", F.expr("(rest - ahead) div rows").alias("words")).coalesce(1), "cuts")


def _with_draws(rows: DataFrame, blocks: DataFrame, cuts: DataFrame, c: Mixing) -> DataFrame:
    """Adds ``draws`` to rows with sid, bits, doc_id, text_key and filled (has words): array of (epoch, words, block, shard,
    place), words null where the whole document is drawn. Both tables are sent to all executors: their size is bounded."""
    ends = cuts.withColumnsRenamed({"at": "cut_at", "then": "cut_then", "words": "cut_words"})
    table = blocks.join(F.broadcast(ends), ["sid", "epoch"], "left").where("rest is null or cut_at is not null")
    draws = []
    for e in range(c.most):
        at, then = _place(e, c)
        here = table.where(F.col("epoch") == e).drop("epoch").withColumnsRenamed({x: f"{x}{e}" for x in ("block", "shard", "rest", "cut_at", "cut_then", "cut_words")})
        rows = rows.withColumn(f"at{e}", at).withColumn(f"then{e}", then).withColumn(f"block{e}", _block(F.col(f"at{e}")))
        rows = rows.join(F.broadcast(here), ["sid", f"block{e}"], "left")
        this, end = F.struct(f"at{e}", f"then{e}"), F.struct(F.col(f"cut_at{e}"), F.col(f"cut_then{e}"))
        cut = F.col(f"rest{e}").isNotNull()
        last = cut & (this == end)
        taken = F.col("filled") & F.col(f"shard{e}").isNotNull() & (~cut | (this < end) | (last & (F.col(f"cut_words{e}") > 0)))
        place = F.xxhash64("doc_id", "text_key", F.lit(c.seed), F.lit(-1 - e))
        draw = F.struct(F.lit(e).alias("epoch"), F.when(last, F.col(f"cut_words{e}")).alias("words"), F.col(f"block{e}").alias("block"), F.col(f"shard{e}").alias("shard"), place.alias("place"))
        draws.append(F.when(taken, draw))
    return rows.withColumn("draws", F.array_compact(F.array(*draws)))


def _planned(docs: DataFrame, c: Mixing) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    sized = written(_sized(docs), "sizes")
    sources = _sources(sized, c)
    rows = _with_source(sized, sources)
    blocks, parts = _drawn(rows, sources, c)
    return rows, sources, blocks, _cuts(rows, blocks, c), parts


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    told = sources.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(told), rows["source"].eqNullSafe(told["__source"])).drop("__source")


def mix_plan(docs: DataFrame, c: Mixing = Mixing()) -> DataFrame:
    """One row per document: doc_id, text_key, source, size, source_size, target, taken and draws.

    docs has doc_id, text and source. A draw is (epoch, words, block, shard, place): the words that the mix takes from
    the document's start in that epoch, and where they go. Whole documents are drawn, but for one place per source where
    its target is met: there a document is cut. Rows that repeat doc_id and text have the same draws and count as often
    as they occur; where they are cut, each gives an equal number of whole words, so taken words miss a target by less
    than one word a repeat. No document exceeds ``most`` draws. Null and empty texts have size 0 and no draws. Null
    sources are one source, the last. Orders are hashes of doc_id and text, so reruns agree under any partitioning. An
    empty table gives no rows.
    """
    rows, _, blocks, cuts, _ = _planned(docs, c)
    rows = _with_draws(rows.withColumn("filled", F.col("size") > 0), blocks, cuts, c)
    draws = F.transform("draws", lambda d: d.withField("words", F.coalesce(d["words"], F.col("size"))))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"])
    rows = rows.withColumn("draws", draws)
    return rows.select("doc_id", "text_key", "source", "size", "source_size", "target", taken.alias("taken"), "draws")


def mixed(docs: DataFrame, c: Mixing = Mixing()) -> DataFrame:
    """The mix: the columns of docs, a row per draw, ordered by ``place`` in parts of shards.

    docs has doc_id, text and source; n_chars, where it is there, is set anew. A document that is cut keeps its first
    words, parted by single spaces. Documents without words are not in a mix. Nulls and repeated rows as in mix_plan; an
    empty table stays empty.
    """
    _, sources, blocks, cuts, parts = _planned(docs, c)
    text = F.col("text").cast("string")
    row = whole_row(docs).alias("__row")
    key = F.xxhash64(text).alias("text_key")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), key, F.col("source").cast("string").alias("source"), F.coalesce(text.rlike(WORD), F.lit(False)).alias("filled"))
    rows = _with_draws(_with_source(rows, sources), blocks, cuts, c).select("__row", F.explode("draws").alias("draw"))
    rows = rows.repartition("draw.shard", F.pmod("draw.place", F.lit(parts))).sortWithinPartitions("draw.shard", "draw.place")
    words = F.filter(F.split(F.col("__row.text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, 1, F.coalesce(F.col("draw.words"), F.lit(1)).cast("int")), " ")
    text = F.when(F.col("draw.words").isNotNull(), cut).otherwise(F.col("__row.text"))
    anew = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[anew.get(x, F.col("__row")[x]).alias(x) for x in docs.columns])

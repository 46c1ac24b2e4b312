"""Hard negatives by an exact nearest-neighbour join over Voronoi cells.

Vectors get one more component that gives all the same norm M, anchors get a zero there: the squared distance is then
the anchor's squared norm plus M squared less twice the inner product, so the largest products are the least distances.
Every vector lies in the cell of its nearest pivot; anchors are grouped by their nearest pivot. A group first meets the
vectors of its own cell. What it finds bounds how far its anchors need to look, and by the triangle inequality a vector
of another cell goes to the groups it might still serve and to no other. A task joins one block of a group's anchors with
one block of vectors, exactly, and the blocks' first rows are merged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small_batches, written


@dataclass(frozen=True)
class Negatives:
    """dims, scale: length of vectors; a component x becomes floor(scale x). every: anchors are the ids it divides.
    positives, negatives: wanted for each anchor, and for each positive of it. least, most: percent of a positive's score
    that its negatives have. anchors, block: anchors and vectors of one task's join. least_pivots, pivots: how many there
    are, one per ``anchors`` anchors between the two. sample: rows a pivot that they are fitted on."""

    dims: int = 64
    scale: int = 256
    every: int = 50
    positives: int = 5
    negatives: int = 3
    least: int = 50
    most: int = 95
    anchors: int = 32_768
    block: int = 32_768
    least_pivots: int = 8
    pivots: int = 1024
    sample: int = 16


SHAPE = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_ROW = "place long, vec_id long, label long, vector array<double>"


def usable(vectors: DataFrame, c: Negatives) -> DataFrame:
    """place, vec_id, label and vector (whole numbers as doubles) of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == c.dims) & ~bad)
    return rows.select(F.monotonically_increasing_id().alias("place"), "vec_id", "label", F.transform("embedding", lambda x: F.floor(x * F.lit(float(c.scale))).cast("double")).alias("vector"))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors with their extra component to pivots."""
    x = np.column_stack([x, extra])
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0))


def _pivots(rows: DataFrame, norm: float, n: int, c: Negatives) -> np.ndarray:
    """Centres of a bounded sample in the order of a hash, after a few rounds of k-means."""
    sample = rows.select("vector", F.xxhash64("vec_id", "place").alias("h")).orderBy("h", "vector").limit(n * c.sample).collect()
    x = np.array([r.vector for r in sample])
    x = np.unique(np.column_stack([x, np.sqrt(np.maximum(norm - (x**2).sum(1), 0))]), axis=0)
    centres = x[np.random.default_rng(1).permutation(len(x))[:n]]
    for _ in range(5):
        own = _distances(x[:, :-1], x[:, -1], centres).argmin(1)
        centres = np.array([x[own == i].mean(0) if (own == i).any() else centres[i] for i in range(len(centres))])
    return centres


@dataclass
class _Groups:
    """Anchor groups on the driver, one entry a pivot: anchors in each, their least and greatest distance to the pivot, and
    the distances between which they still look."""

    pivots: np.ndarray
    norm: float
    many: np.ndarray
    low: np.ndarray
    high: np.ndarray
    inner: np.ndarray = field(default_factory=lambda: np.zeros(0))
    outer: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def serves(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Which groups beside the one of its own cell a vector might serve, a row a vector."""
        d, slack = _distances(x, np.sqrt(np.maximum(self.norm - (x**2).sum(1), 0)), self.pivots), 1e-6 * (1 + math.sqrt(self.norm))
        found = (np.maximum(d - self.high, self.low - d) <= self.outer + slack) & (d + self.high >= self.inner - slack) & (self.many > 0)
        found[np.arange(len(x)), cell] = False
        return found


def _cells(rows: DataFrame, pivots: np.ndarray, norm: float, c: Negatives) -> DataFrame:
    """Adds each vector's cell, and for anchors their group and distance to its pivot."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = _matrix(b.column(3), c.dims), b.column(1).to_numpy()
            cell = _distances(x, np.sqrt(np.maximum(norm - (x**2).sum(1), 0)), sent.value).argmin(1)
            d, other = _distances(x, np.zeros(len(x)), sent.value), ids % c.every != 0
            group = d.argmin(1)
            reach = pa.array(d[np.arange(len(x)), group], mask=other)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(group.astype(np.int32), mask=other), reach], ["place", "vec_id", "label", "vector", "cell", "group", "reach"])

    return rows.mapInArrow(run, _ROW + ", cell int, group int, reach double")


def _mixed(place: np.ndarray) -> np.ndarray:
    h = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(33)).astype(np.int64)


def _dealt(cells: DataFrame, g: _Groups, near: bool, c: Negatives) -> tuple[DataFrame, np.ndarray]:
    """Vectors with the group, anchor block and block they go to, and how many blocks each group has: those of the
    group's own cell, or those of others that might serve it."""
    sc = cells.sparkSession.sparkContext
    sent = sc.broadcast(g)

    def groups(x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if near:
            row = np.flatnonzero(sent.value.many[cell] > 0)
            return row, cell[row]
        return np.nonzero(sent.value.serves(x, cell))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sent.value.many), np.int64)
        for b in batches:
            n += np.bincount(groups(_matrix(b.column(1), c.dims), b.column(0).to_numpy())[1], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["group", "n"])

    blocks = np.zeros(len(g.many), np.int64)
    for r in cells.select("cell", "vector").mapInArrow(count, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect():  # a row a pivot
        blocks[r.group] = -(-r.n // c.block)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = -(-sent.value.many // c.anchors)
        for b in batches:
            row, group = groups(_matrix(b.column(3), c.dims), b.column(4).to_numpy())
            part = np.concatenate([np.arange(n) for n in parts[group]]) if len(group) else np.zeros(0, np.int64)
            row, group = np.repeat(row, parts[group]), np.repeat(group, parts[group])
            for i in range(0, len(row), 4096):
                r, k = row[i : i + 4096], group[i : i + 4096]
                block = _mixed(b.column(0).to_numpy()[r]) % blocks[k]
                keys = [pa.array(v.astype(np.int32)) for v in (k, part[i : i + 4096], block)]
                yield pa.RecordBatch.from_arrays([*(b.column(j).take(pa.array(r)) for j in (1, 2, 3)), *keys], ["vec_id", "label", "vector", "group", "part", "block"])

    shape = "vec_id long, label long, vector array<double>, group int, part int, block int"
    return cells.select("place", "vec_id", "label", "vector", "cell").mapInArrow(deal, shape), blocks


def _joined(cells: DataFrame, anchors: DataFrame, g: _Groups, near: bool, c: Negatives, local: Callable, shape: str, name: str) -> DataFrame:
    """Joins each group's anchors with the vectors dealt to it, block by block."""
    vectors, blocks = _dealt(cells, g, near, c)
    spark = cells.sparkSession
    parts = -(-g.many // c.anchors)
    some = [(int(i), int(parts[i]), int(blocks[i])) for i in np.flatnonzero((g.many > 0) & (blocks > 0))]
    table = spark.createDataFrame(some, "group int, parts int, blocks int")  # a row a pivot
    left = anchors.join(F.broadcast(table), "group").withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("parts", "blocks")
    keys = ["group", "part", "block"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = local(a, b.sort_by("vec_id")) if a.num_rows and b.num_rows else []
        columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    kinds = {k: pa.int64() for k in (x.split()[0] for x in shape.split(", "))}
    return written(left.groupBy(keys).cogroup(vectors.groupBy(keys)).applyInArrow(run, shape), name)


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, the earlier place first among equal ones."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.argsort(-scores[at], kind="stable")[:k]]


#: Anchors whose scores a task holds at once.
_ROWS = 128


def _positives(c: Negatives) -> Callable:
    def local(a: pa.Table, b: pa.Table) -> list[tuple]:
        out, labels, ids = [], b["label"].to_numpy(), b["vec_id"].to_numpy()
        x, q = _matrix(b["vector"], c.dims), _matrix(a["vector"], c.dims)
        place, own, told = (a[k].to_numpy() for k in ("place", "vec_id", "label"))
        bound = a["bound"].to_numpy()  # of the last positive so far; NaN where there are too few
        for label in np.unique(told):
            at = np.flatnonzero(labels == label)
            mine, those = ids[at], np.flatnonzero(told == label)
            for i in range(0, len(those), _ROWS):
                rows = those[i : i + _ROWS]
                scores = q[rows] @ x[at].T
                for r, s in zip(rows, scores, strict=True):
                    keep = mine != own[r]
                    if not math.isnan(bound[r]):
                        keep &= s >= bound[r]
                    keep = np.flatnonzero(keep)
                    out += [(int(place[r]), int(mine[keep[j]]), int(s[keep[j]])) for j in _first(s[keep], c.positives)]
        return out

    return local


def _negatives(c: Negatives) -> Callable:
    def local(a: pa.Table, b: pa.Table) -> list[tuple]:
        out, labels, ids = [], b["label"].to_numpy(), b["vec_id"].to_numpy()
        x, q = _matrix(b["vector"], c.dims), _matrix(a["vector"], c.dims)
        place, told, wanted = a["place"].to_numpy(), a["label"].to_numpy(), a["wanted"].to_pylist()
        for i in range(0, len(q), _ROWS):
            scores = q[i : i + _ROWS] @ x.T
            for r, s in enumerate(scores, i):
                low = min(w["low"] for w in wanted[r])
                high = max(w["score"] for w in wanted[r])
                keep = np.flatnonzero((s >= low) & (100 * s <= c.most * high) & (labels != told[r]))
                keep = keep[np.argsort(-s[keep], kind="stable")]
                down = -100 * s[keep]
                for w in wanted[r]:
                    first = np.searchsorted(down, -c.most * w["score"], "left")
                    last = np.searchsorted(down, -c.least * w["score"], "right")
                    for j in keep[first : min(last, first + c.negatives)]:
                        out.append((int(place[r]), w["nth"], int(ids[j]), int(s[j])))
        return out

    return local


def _looks(anchors: DataFrame, norm: float, pivots: int, outer, inner) -> tuple[np.ndarray, np.ndarray]:
    """The groups' outer and inner distances from scores: those of the anchors that look furthest and nearest. A null
    outer score looks everywhere."""
    away = lambda s: F.sqrt(F.greatest(F.col("norm") + F.lit(norm) - 2 * s, F.lit(0.0)))
    got = anchors.groupBy("group").agg(F.max(F.when(outer.isNull(), float("inf")).otherwise(away(outer))).alias("o"), F.min(away(inner)).alias("i"))
    far, close = np.full(pivots, -np.inf), np.full(pivots, np.inf)
    for r in got.collect():  # a row a pivot
        far[r.group], close[r.group] = r.o, r.i
    return far, close


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    return found.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("nth") <= k)


def hard_negatives(vectors: DataFrame, c: Negatives = Negatives()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    vectors has vec_id, label and embedding; other columns are ignored. Rows with a null id, label, vector or component,
    with a component that isn't finite, or of another length than ``dims`` take no part. Scores are exact while components
    stay under 2^23 after scaling. Rows that repeat an id are rows of their own and no positives of each other; a repeated
    anchor has its own results. Ties go to the smaller id. An anchor without positives, or a positive without negatives
    in its range, gives no row; neither does an empty table.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    squared = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)
    rows = written(usable(vectors, c), "vectors")
    anchor = F.col("vec_id") % c.every == 0
    told = rows.agg(F.max(squared).alias("norm"), F.count(F.when(anchor, 1)).alias("anchors")).first()
    if not told.anchors:
        return spark.createDataFrame([], SHAPE)

    pivots = _pivots(rows, told.norm, min(c.pivots, max(c.least_pivots, -(-told.anchors // c.anchors))), c)
    cells = written(_cells(rows, pivots, told.norm, c), "cells")
    anchors = cells.where("group is not null").withColumn("norm", squared)
    n = len(pivots)
    groups = _Groups(pivots, told.norm, np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf))
    for r in anchors.groupBy("group").agg(F.count("*").alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high")).collect():  # a row a pivot
        groups.many[r.group], groups.low[r.group], groups.high[r.group] = r.n, r.low, r.high

    # Positives: in the own cell, then among vectors of other cells that might come before the last one found.
    query = anchors.select("group", "place", "vec_id", "label", "vector", "norm")
    shape = "place long, id long, score long"
    near = _joined(cells, query.withColumn("bound", F.lit(None).cast("double")), groups, True, c, _positives(c), shape, "near_positives")
    last = _best(near, ["place"], c.positives).groupBy("place").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("bound"))
    bounded = written(query.join(last.where(F.col("n") == c.positives).drop("n"), "place", "left"), "bounded")
    groups.outer, _ = _looks(bounded, told.norm, n, F.col("bound"), F.lit(0.0))
    groups.inner = np.full(n, -np.inf)
    far = _joined(cells, bounded, groups, False, c, _positives(c), shape, "far_positives")
    positives = written(_best(near.unionByName(far), ["place"], c.positives), "positives")

    # Negatives, in the same two steps.
    wanted = positives.where("score >= 0").select("place", F.struct("nth", "score", (F.col("score") * c.least / 100).alias("low")).alias("w"))
    wanted = wanted.groupBy("place").agg(F.sort_array(F.collect_list("w")).alias("wanted"))  # at most ``positives`` each
    asked = written(query.join(wanted, "place"), "asked")
    shape = "place long, nth long, id long, score long"
    near = _joined(cells, asked, groups, True, c, _negatives(c), shape, "near_negatives")
    third = _best(near.withColumnRenamed("nth", "positive"), ["place", "positive"], c.negatives).groupBy("place", "positive").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("third"))
    third = third.where(F.col("n") == c.negatives).groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("positive", "third"))).alias("thirds"))
    closer = F.transform("wanted", lambda w: F.struct(w["nth"].alias("nth"), w["score"].alias("score"), F.greatest(w["low"], F.coalesce(F.try_element_at("thirds", w["nth"].cast("long")), w["low"])).alias("low")))
    asked = written(asked.join(third, "place", "left").withColumn("wanted", closer).drop("thirds"), "narrowed")
    groups.outer, groups.inner = _looks(asked, told.norm, n, F.array_min(F.transform("wanted", lambda w: w["low"])), F.array_max(F.transform("wanted", lambda w: w["score"])) * c.most / 100)
    far = _joined(cells, asked, groups, False, c, _negatives(c), shape, "far_negatives")
    best = _best(near.unionByName(far).withColumnRenamed("nth", "positive"), ["place", "positive"], c.negatives)
    result = best.withColumnsRenamed({"nth": "rank", "id": "negative_id", "score": "negative_score"}).join(
        positives.select("place", F.col("nth").cast("long").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["place", "positive"]
    )
    result = result.join(anchors.select("place", F.col("vec_id").alias("anchor_id")), "place")
    return result.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def sql(c: Negatives = Negatives()) -> str:
    """The query's result for a table with unique ids, in SQL."""
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({c.scale} * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = {c.dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS id, a.label = o.label AS alike, list_dot_product(a.e, o.e)::BIGINT AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % {c.every} = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {c.positives})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND {c.least} * positive_score <= 100 * score AND 100 * score <= {c.most} * positive_score
QUALIFY rank <= {c.negatives}"""

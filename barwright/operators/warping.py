"""Regimes by the shape of windows: k-means under dynamic time warping.

Windows are rows, so everything splits by window. A round sends the centres, assigns every window to the nearest one and adds
up where its values are aligned to the centre's places; the new centres are those places' means (barycentre averaging).
A lower bound from the centre's envelope spares most warpings where a band is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import saved
from .assembly import nearest_fill


def windows(df: DataFrame, column: str, length: int = 20, step: int = 5) -> DataFrame:
    """(symbol, start, values): the windows of ``length`` rows that start at every ``step``-th row_id, without nulls or NaN,
    brought to mean 0 and deviation 1; constant ones are 0 everywhere."""
    x = F.col(f"`{column}`").cast("double")
    rows = df.select("symbol", "row_id", x.alias("x")).where("x is not null and not isnan(x)")
    first = F.greatest(F.lit(0), F.ceil((F.col("row_id") - length + 1) / step))
    last = F.floor(F.col("row_id") / step)
    rows = rows.where(first <= last).select("symbol", "row_id", "x", F.explode(F.sequence((first * step).cast("long"), (last * step).cast("long"), F.lit(step).cast("long"))).alias("start"))
    made = rows.groupBy("symbol", "start").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("row_id", "x"))).alias("v"))
    flat = F.col("s") <= 1e-12 * F.abs("m")
    return made.where(F.col("n") == length).select("symbol", "start", F.transform("v", lambda v: F.when(flat, 0.0).otherwise((v["x"] - F.col("m")) / F.col("s"))).alias("values"))


def _costs(x: np.ndarray, centre: np.ndarray, band: int | None) -> np.ndarray:
    """Squared warping costs of all starts of each row of x against all starts of the centre."""
    n, width = x.shape
    length = len(centre)
    d = np.full((width + 1, length + 1, n), np.inf)
    d[0, 0] = 0
    for i in range(1, width + 1):
        low, high = (1, length) if band is None else (max(1, i - band), min(length, i + band))
        for j in range(low, high + 1):
            d[i, j] = (x[:, i - 1] - centre[j - 1]) ** 2 + np.minimum(np.minimum(d[i - 1, j], d[i, j - 1]), d[i - 1, j - 1])
    return d


def warped(x: np.ndarray, centre: np.ndarray, band: int | None = None) -> np.ndarray:
    """The warping distance of each row of x to the centre."""
    return np.sqrt(_costs(x, centre, band)[-1, -1])


def _bound(x: np.ndarray, centre: np.ndarray, band: int) -> np.ndarray:
    """No warping within the band is shorter: distances to the centre's envelope."""
    at = [slice(max(0, i - band), i + band + 1) for i in range(len(centre))]
    high, low = np.array([centre[a].max() for a in at]), np.array([centre[a].min() for a in at])
    return np.sqrt((np.maximum(x - high, 0) ** 2 + np.maximum(low - x, 0) ** 2).sum(1))


def nearest(x: np.ndarray, centres: np.ndarray, band: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of ties, and its distance."""
    best, label = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
    for k, centre in enumerate(centres):
        rows = np.arange(len(x)) if band is None else np.flatnonzero(_bound(x, centre, band) < best)
        if len(rows):
            d = warped(x[rows], centre, band)
            closer = d < best[rows]
            best[rows[closer]], label[rows[closer]] = d[closer], k
    return label, best


def aligned(x: np.ndarray, centre: np.ndarray, band: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the values that the best warpings bring to each place of the centre; steps along the diagonal go
    first among equal ones."""
    d, n = _costs(x, centre, band), len(x)
    sums, many = np.zeros(len(centre)), np.zeros(len(centre))
    i, j, rows = np.full(n, x.shape[1]), np.full(n, len(centre)), np.arange(n)
    while len(rows):
        a, b = i[rows], j[rows]
        np.add.at(sums, b - 1, x[rows, a - 1])
        np.add.at(many, b - 1, 1)
        both, up, left = d[a - 1, b - 1, rows], d[a - 1, b, rows], d[a, b - 1, rows]
        diagonal = (both <= up) & (both <= left)
        upward = ~diagonal & (up <= left)
        i[rows], j[rows] = a - (diagonal | upward), b - ~upward
        rows = rows[(i[rows] > 0) & (j[rows] > 0)]
    return sums, many


def _batches(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield part, part.column(place).flatten().to_numpy().reshape(part.num_rows, -1)


def _first(made: DataFrame, clusters: int, sample: int, band: int | None) -> np.ndarray:
    """Centres to begin with: of a bounded sample in the order of a hash, the first, then always the furthest from those."""
    rows = made.orderBy(F.xxhash64("symbol", "start"), "symbol", "start").limit(sample).collect()
    x = np.array([r["values"] for r in rows])
    chosen, far = [0], warped(x, x[0], band)
    while len(chosen) < min(clusters, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, warped(x, x[chosen[-1]], band))
    return x[chosen]


def fit_shapes(made: DataFrame, clusters: int = 4, rounds: int = 10, band: int | None = None, sample: int = 256) -> tuple[np.ndarray, list[float]]:
    """Centres of the windows and the sum of squared distances of every round; ends when it no longer falls. A centre
    without windows stays. No windows give no centres."""
    if made.isEmpty():
        return np.zeros((0, 0)), []
    centres, history = _first(made, clusters, sample, band), []
    k, length = centres.shape
    for _ in range(rounds):
        sent = made.sparkSession.sparkContext.broadcast(centres)
        parts = made.select("values").mapInArrow(_moved(sent, band), "v array<double>").rdd.map(lambda r: np.array(r[0]))
        total = parts.treeReduce(np.add)
        sent.destroy()
        history.append(float(total[-1]))
        sums, many = total[:-1].reshape(2, k, length)
        if len(history) > 1 and history[-1] >= history[-2] * (1 - 1e-9):
            break
        centres = np.where(many > 0, sums / np.maximum(many, 1), centres)
    return centres, history


def _moved(sent, band: int | None):
    """What adds up a partition's alignments and squared distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        total, inertia = np.zeros((2, *centres.shape)), 0.0
        for _, x in _batches(batches, 0):
            label, d = nearest(x, centres, band)
            inertia += float((d * d).sum())
            for c in np.unique(label):
                sums, many = aligned(x[label == c], centres[c], band)
                total[0, c] += sums
                total[1, c] += many
        yield pa.RecordBatch.from_arrays([pa.array([[*total.ravel().tolist(), inertia]], pa.list_(pa.float64()))], ["v"])

    return run


def window_shapes(made: DataFrame, centres: np.ndarray, band: int | None = None) -> DataFrame:
    """(symbol, start, label): each window's nearest centre."""
    sent = made.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _batches(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest(x, sent.value, band)[0])], ["symbol", "start", "label"])

    return made.select("symbol", "start", "values").mapInArrow(run, "symbol string, start long, label int")


def shape_regimes(df: DataFrame, column: str, clusters: int = 4, length: int = 20, step: int = 5, rounds: int = 10, band: int | None = None) -> DataFrame:
    """symbol, row_id and regime of every row: the label of the latest window that holds it, else that of the nearest row
    with one, the earlier of ties; 0 for a symbol without windows."""
    made = saved(windows(df, column, length, step), "windows")
    centres, _ = fit_shapes(made, clusters, rounds, band)
    keys = df.select("symbol", "row_id")
    if not len(centres):
        return keys.withColumn("regime", F.lit(0))
    rows = window_shapes(made, centres, band).select("symbol", "start", "label", F.explode(F.sequence(F.col("start"), F.col("start") + length - 1)).alias("row_id"))
    latest = rows.groupBy("symbol", "row_id").agg(F.max_by("label", "start").alias("label"))
    filled = nearest_fill(keys.join(latest, ["symbol", "row_id"], "left"), "label")
    return filled.select("symbol", "row_id", F.coalesce("label_filled", F.lit(0)).cast("int").alias("regime"))

"""Training by the adaptive loss: a linear forecast, the threshold k and the asymmetry are learned together.

Each row of the training table is one batch, since the loss weighs rows within their batch. An epoch sends the parameters,
sums losses and gradients in every partition, adds the sums in a tree and takes one step of Adam on the driver, which
holds a few numbers. The asymmetric weights count each side of a batch; counts have no gradient, so with them the loss
need not fall, while without them it does. Weights of attention sum to one over the lookback and multiply the whole loss, so they have no
gradient and are not trained.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import saved
from .loss import LossConfig, multiplier


@dataclass(frozen=True)
class Training:
    """epochs, rate: of Adam. learn_k, learn_alpha: whether the loss's own parameters are learned. least_k: k stays above."""

    epochs: int = 30
    rate: float = 0.05
    learn_k: bool = True
    learn_alpha: bool = True
    least_k: float = 1e-3


@dataclass(frozen=True)
class Trained:
    """weights: per standardised feature, then the constant. history: (epoch, loss, k, alpha) before each step."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    k: float
    alpha: float
    history: list[tuple[int, float, float, float]]

    def forecast(self, df: DataFrame, name: str = "yhat") -> DataFrame:
        """Adds the forecast; null features count as their mean."""
        parts = [F.lit(float(w)) * F.coalesce((F.col(f"`{f}`") - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)) for f, w, m, s in zip(self.features, self.weights, self.mean, self.scale, strict=False)]
        return df.withColumn(name, sum(parts, F.lit(float(self.weights[-1]))))


def gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, vol: np.ndarray, regime: np.ndarray, volume: np.ndarray, batch: np.ndarray, c: LossConfig) -> np.ndarray:
    """The gradient's sums over all rows, then the sum of losses and the number of rows. theta: weights, constant, k and
    the asymmetry's logit. ``batch`` numbers the batches from 0."""
    weights, k, alpha = theta[:-2], theta[-2], 1 / (1 + math.exp(-theta[-1]))
    r = y - (x @ weights[:-1] + weights[-1])
    s = np.maximum(vol, 1e-8)
    free = np.abs(r) < c.clip * s
    r = np.clip(r, -c.clip * s, c.clip * s)
    delta, size = regime * k * s, np.abs(r)
    small = size <= delta
    base = np.where(small, 0.5 * r * r, delta * (size - 0.5 * delta))
    slope = np.where(small, r, delta * np.sign(r))
    by_delta = np.where(small, 0.0, size - delta)
    weight, by_alpha = np.ones(len(r)), np.zeros(len(r))
    n = np.bincount(batch)
    if c.asymmetric:
        low = r < 0
        side = np.where(low, np.bincount(batch, low)[batch], np.bincount(batch, ~low)[batch])
        share = np.where(low, alpha, 1 - alpha) * n[batch] / side
        weight = np.clip(share, 0.1, 10.0)
        by_alpha = np.where((share > 0.1) & (share < 10), np.where(low, 1.0, -1.0) * n[batch] / side, 0.0)
    if c.volume_weighted:
        level = (np.bincount(batch, volume) / np.maximum(n, 1))[batch]
        counts = level != 0
        part = np.divide(volume, level, out=np.zeros(len(r)), where=counts)
    else:
        counts, part = np.ones(len(r), bool), np.ones(len(r))
    ahead = -(weight * part * slope * free)
    own = [weight @ (part * by_delta * regime * s), (base * part) @ by_alpha * alpha * (1 - alpha)]
    return np.concatenate([ahead @ x, [ahead.sum()], own, [(base * weight * part).sum(), counts.sum()]])


def batches_of(df: DataFrame, features: list[str], mean: np.ndarray, scale: np.ndarray, target: str = "y") -> DataFrame:
    """A row per (symbol, batch_id) with its samples; features are standardised, null ones 0. Rows without a target, a
    volatility or a volume are left out."""
    x = F.array(*[F.coalesce((F.col(f"`{f}`").cast("double") - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)) for f, m, s in zip(features, mean, scale, strict=True)])
    sample = F.struct(x.alias("x"), F.col(target).cast("double").alias("y"), F.col("vol").cast("double").alias("vol"), multiplier(F.col("regime_name")).alias("regime"), F.col("volume").cast("double").alias("volume"))
    known = df.where(f"{target} is not null and vol is not null and volume is not null")
    return known.groupBy("symbol", "batch_id").agg(F.collect_list(sample).alias("samples"))  # a batch is as many rows as it was made of


def _summed(sent, width: int, c: LossConfig):
    """What adds up a partition's gradients, losses and rows, one batch of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 5)
        for b in batches:
            column = b.column(0)
            rows = column.flatten()
            if len(rows):
                batch = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
                get = lambda name: rows.field(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                x = rows.field("x").flatten().to_numpy().reshape(len(rows), width)
                total += gradient(sent.value, x, get("y"), get("vol"), get("regime"), get("volume"), batch, c)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    return run


def train(df: DataFrame, features: list[str], c: LossConfig = LossConfig(), t: Training = Training(), target: str = "y") -> Trained:
    """Trains on all rows with symbol, batch_id, the target, vol, volume and regime_name; the constant starts as the target's
    mean, other weights at 0. A table without rows gives the start. A quantile loss is an error: it has no gradient in k."""
    if c.quantile is not None:
        raise ValueError("the quantile loss is not trained")
    width = len(features)
    row = df.agg(F.avg(target).alias("y"), *[F.avg(f"`{f}`").alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f"`{f}`").alias(f"s{i}") for i, f in enumerate(features)]).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(width)])
    scale = np.array([row[f"s{i}"] or 1.0 for i in range(width)])
    rows = saved(batches_of(df, features, mean, scale, target), "batches").select("samples")
    theta = np.concatenate([np.zeros(width), [row.y or 0.0, c.k, math.log(c.alpha / (1 - c.alpha))]])
    first, second, history = np.zeros(len(theta)), np.zeros(len(theta)), []
    for epoch in range(1, t.epochs + 1):
        sent = df.sparkSession.sparkContext.broadcast(theta)
        parts = rows.mapInArrow(_summed(sent, width, c), "v array<double>").rdd.map(lambda r: np.array(r[0]))
        total = parts.treeReduce(np.add) if parts.getNumPartitions() else np.zeros(width + 5)
        sent.destroy()
        n = total[-1]
        if not n:
            break
        history.append((epoch, float(total[-2] / n), float(theta[-2]), float(1 / (1 + math.exp(-theta[-1])))))
        g = total[:-2] / n * np.concatenate([np.ones(width + 1), [t.learn_k, t.learn_alpha]])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - t.rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
        theta[-2] = max(theta[-2], t.least_k)
    return Trained(list(features), mean, scale, theta[:-2], float(theta[-2]), float(1 / (1 + math.exp(-theta[-1]))), history)

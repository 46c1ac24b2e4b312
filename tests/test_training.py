"""Training against a single process with numeric gradients, and against the loss operator."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import loss as lo
from barwright.operators import training as tr

FEATURES = ["a", "b"]
SHAPE = "symbol string, row_id long, batch_id long, a double, b double, y double, vol double, volume double, regime_name string"


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(4), []
    for i in range(600):
        a, b = rng.gauss(3, 2), rng.gauss(0, 1)
        out.append(("ST"[i % 2], i // 2, i // 60, a, b, 0.4 * a - b + rng.gauss(0, 1) + 3 * (rng.random() < 0.1), rng.uniform(0.5, 2), rng.uniform(1, 9), rng.choice([*lo.REGIME_MULTIPLIERS, "other"])))
    return out


def value(theta, rows, mean, scale, c):
    """The mean loss, batch by batch and row by row."""
    total, by = 0.0, {}
    for r in rows:
        by.setdefault((r[0], r[2]), []).append(r)
    alpha = 1 / (1 + math.exp(-theta[-1]))
    for batch in by.values():
        res = []
        for r in batch:
            e = r[5] - (theta[0] * (r[3] - mean[0]) / scale[0] + theta[1] * (r[4] - mean[1]) / scale[1] + theta[2])
            res.append(max(-c.clip * r[6], min(c.clip * r[6], e)))
        neg = sum(e < 0 for e in res)
        level = sum(r[7] for r in batch) / len(batch)
        for r, e in zip(batch, res, strict=True):
            delta = lo.REGIME_MULTIPLIERS.get(r[8], 1.0) * theta[-2] * r[6]
            base = 0.5 * e * e if abs(e) <= delta else delta * (abs(e) - 0.5 * delta)
            share = alpha * len(batch) / neg if e < 0 else (1 - alpha) * len(batch) / (len(batch) - neg)
            total += base * max(0.1, min(10, share)) * r[7] / level
    return total / len(rows)


def test_steps_equal_a_single_process(spark, rows):
    c, t = lo.LossConfig(alpha=0.4, k=1.3), tr.Training(epochs=6, rate=0.05)
    got = tr.train(spark.createDataFrame(rows, SHAPE).repartition(5), FEATURES, c, t)
    x = np.array([r[3:5] for r in rows])
    mean, scale = x.mean(0), x.std(0)
    theta = np.array([0, 0, np.mean([r[5] for r in rows]), 1.3, math.log(0.4 / 0.6)])
    first, second = np.zeros(5), np.zeros(5)
    for e in range(1, 7):
        assert got.history[e - 1][1] == pytest.approx(value(theta, rows, mean, scale, c), rel=1e-9)
        g = np.array([(value(theta + h, rows, mean, scale, c) - value(theta - h, rows, mean, scale, c)) / 2e-6 for h in np.eye(5) * 1e-6])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - 0.05 * (first / (1 - 0.9**e)) / (np.sqrt(second / (1 - 0.999**e)) + 1e-8)
    assert np.concatenate([got.weights, [got.k]]) == pytest.approx(theta[:-1], abs=1e-6) and got.alpha == pytest.approx(1 / (1 + math.exp(-theta[-1])), abs=1e-6)


@pytest.mark.parametrize("asymmetric", [False, True])
def test_the_trained_loss_is_the_operators(spark, rows, asymmetric):
    df = spark.createDataFrame(rows, SHAPE)
    c = lo.LossConfig(alpha=0.4, asymmetric=asymmetric)
    got, again = (tr.train(df, FEATURES, c, tr.Training(epochs=n, learn_k=False, learn_alpha=False)) for n in (50, 51))
    assert got.k == c.k and got.alpha == pytest.approx(0.4)
    mean = lo.losses(got.forecast(df), c).agg(F.avg("loss")).first()[0]
    assert mean == pytest.approx(again.history[-1][1], rel=1e-9)
    if not asymmetric:
        assert got.history[-1][1] < 0.6 * got.history[0][1] and got.weights[:2] / got.scale == pytest.approx([0.4, -1], abs=0.1)


def test_training_on_odd_tables(spark, rows):
    none = tr.train(spark.createDataFrame([], SHAPE), FEATURES)
    assert none.history == [] and (none.weights == 0).all()
    odd = [*rows[:90], ("S", 700, 50, None, 1.0, 1.0, 1.0, 1.0, None), ("S", 701, 50, 1.0, 1.0, None, 1.0, 1.0, None), ("S", 702, 51, 1.0, 1.0, 1.0, 1.0, 0.0, None), ("S", 703, 51, 1.0, 1.0, 1.0, None, 1.0, None), ("S", 704, 52, 1.0, 1.0, 1.0, 0.0, 2.0, None)]
    got = tr.train(spark.createDataFrame(odd, SHAPE), FEATURES, t=tr.Training(epochs=3))
    assert len(got.history) == 3 and np.isfinite([h[1] for h in got.history]).all()
    assert got.forecast(spark.createDataFrame(odd, SHAPE)).where("yhat is null").count() == 0
    with pytest.raises(ValueError):
        tr.train(spark.createDataFrame(odd, SHAPE), FEATURES, lo.LossConfig(quantile=0.5))

"""Warping against plain loops, and regimes of planted shapes."""

import math
import random

import numpy as np
import pytest

from barwright.operators import warping as wp


def plain(a, b, band=None):
    d = {(-1, -1): 0.0}
    get = lambda i, j: d.get((i, j), math.inf)
    for i in range(len(a)):
        for j in range(len(b)):
            if band is None or abs(i - j) <= band:
                d[i, j] = (a[i] - b[j]) ** 2 + min(get(i - 1, j), get(i, j - 1), get(i - 1, j - 1))
    path, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        path.append((i, j))
        i, j = min([(i - 1, j - 1), (i - 1, j), (i, j - 1)], key=lambda p: get(*p))
    return math.sqrt(d[len(a) - 1, len(b) - 1]), path


@pytest.mark.parametrize("band", [None, 2])
def test_warping_equals_plain_loops(band):
    rng = np.random.default_rng(1)
    x, centres = rng.normal(size=(40, 9)), rng.normal(size=(4, 9))
    want = np.array([[plain(a, c, band)[0] for c in centres] for a in x])
    for k, c in enumerate(centres):
        assert wp.warped(x, c, band) == pytest.approx(want[:, k])
        if band:
            assert (wp._bound(x, c, band) <= want[:, k] + 1e-9).all()
    label, best = wp.nearest(x, centres, band)
    assert label.tolist() == want.argmin(1).tolist() and best == pytest.approx(want.min(1))
    sums, many = np.zeros(9), np.zeros(9)
    for a in x:
        for i, j in plain(a, centres[0], band)[1]:
            sums[j] += a[i]
            many[j] += 1
    got = wp.aligned(x, centres[0], band)
    assert got[0] == pytest.approx(sums) and (got[1] == many).all()


def planted(n=60):
    rng, out = random.Random(2), []
    for i in range(n):
        kind = i % 3
        shift = rng.randrange(3)
        for t in range(20):
            u = (t + shift) / 19
            out.append([u * 4, -u * 4, 3 * math.sin(2 * math.pi * u)][kind] + rng.gauss(0, 0.05))
    return out


@pytest.mark.parametrize("band", [None, 4])
def test_regimes_of_planted_shapes(spark, band):
    x = planted()
    df = spark.createDataFrame([("S", i, v) for i, v in enumerate(x)], "symbol string, row_id long, v double")
    made = wp.windows(df, "v", 20, 20)
    centres, history = wp.fit_shapes(made, 3, band=band)
    assert len(history) > 1 and all(b <= a for a, b in zip(history[:-1], history[1:-1], strict=False)) and history[-1] < history[0]
    got = wp.shape_regimes(df, "v", 3, 20, 20, band=band).toPandas().sort_values("row_id").regime.to_numpy().reshape(-1, 20)
    assert (got == got[:, :1]).all() and all(len(set(got[k::3, 0])) == 1 for k in range(3)) and len(set(got[:, 0])) == 3


def test_windows_and_labels_of_rows(spark):
    rng = random.Random(1)
    rows = [("S", i, None if i == 17 else rng.gauss(0, 1)) for i in range(43)] + [("T", i, 5.0) for i in range(25)] + [("U", i, 1.0 * i) for i in range(4)]
    df = spark.createDataFrame(rows, "symbol string, row_id long, v double")
    made = {(r.symbol, r.start): r["values"] for r in wp.windows(df, "v", 10, 4).collect()}
    assert sorted(s for k, s in made if k == "S") == [0, 4, 20, 24, 28, 32] and made["T", 0] == [0.0] * 10 and not any(k == "U" for k, _ in made)
    assert np.mean(made["S", 20]) == pytest.approx(0, abs=1e-12) and np.std(made["S", 20]) == pytest.approx(1)
    centres, _ = wp.fit_shapes(wp.windows(df, "v", 10, 4), 2)
    label = {(r.symbol, r.start): r.label for r in wp.window_shapes(wp.windows(df, "v", 10, 4), centres).collect()}
    got = {(r.symbol, r.row_id): r.regime for r in wp.shape_regimes(df, "v", 2, 10, 4).collect()}
    held = {r: max(s for k, s in label if k == "S" and s <= r < s + 10) for r in range(43) if any(k == "S" and s <= r < s + 10 for k, s in label)}
    for r in range(43):
        near = min(held, key=lambda h: (abs(h - r), h))
        assert got["S", r] == label["S", held[near]]
    assert len(got) == 72 and all(got["U", i] == 0 for i in range(4))
    none = wp.shape_regimes(df.limit(0), "v")
    assert none.count() == 0

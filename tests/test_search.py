"""Samplers on known functions, rungs and chains against plain versions."""

import math
import random

import numpy as np
import pytest

from barwright.operators import chains as ch
from barwright.operators import samplers as sp
from barwright.operators.tuning import ParamSpec, suggest

PLANE = [ParamSpec("x", -4, 4), ParamSpec("y", 0.01, 100, log=True)]
bowl = lambda p: -((p["x"] - 1.3) ** 2) - math.log10(p["y"] / 3) ** 2
ridge = lambda p: -abs(p["x"] + 2) - 3 * abs(math.log10(p["y"]) - 1) - 0.1 * math.sin(5 * p["x"])


@pytest.mark.parametrize("f", [bowl, ridge])
@pytest.mark.parametrize("sampler", ["tpe", "cma"])
def test_samplers_beat_random_draws(spark, f, sampler):
    best = lambda s, seed: sp.sampled(spark, "a", PLANE, f, 60, s, seed).toPandas().value.max()
    got, even = [[best(s, seed) for seed in range(4)] for s in (sampler, "random")]
    assert np.median(got) > np.median(even)


def test_samplers_are_reproducible_and_take_known_trials(spark):
    again = [[r.params for r in sp.sampled(spark, "a", PLANE, bowl, 14, "tpe", 5).collect()] for _ in range(2)]
    assert again[0] == again[1]
    known = [(p, bowl(p)) for p in suggest(PLANE, 12, 1)]
    assert sp.sampled(spark, "a", PLANE, bowl, 3, "tpe", 5, known).count() == 3
    assert sp.sampled(spark, "a", PLANE, lambda p: math.nan, 12, "tpe").count() == 12
    with pytest.raises(ValueError):
        sp.sampled(spark, "a", PLANE, bowl, 3, "grid")


def test_parzen_is_a_density():
    p = sp.Parzen(np.array([0.0, 0.1, 0.1, 0.8]))
    u = np.linspace(0, 1, 20_001)
    assert np.trapezoid(p.density(u), u) == pytest.approx(1, abs=1e-6) and p.density(np.array([0.1]))[0] > p.density(np.array([0.5]))[0]
    drawn = p.draw(np.random.default_rng(1), 4000)
    assert drawn.min() >= 0 and drawn.max() <= 1 and np.mean(drawn < 0.3) == pytest.approx(np.trapezoid(p.density(u[u < 0.3]), u[u < 0.3]), abs=0.03)


def test_priors_guide_the_sampler(spark):
    rows = [(f"s{k}", i, {"x": 1.2 + 0.01 * k + 0.3 * i, "y": 3.0 + i}, float(-i), "COMPLETE") for k in range(5) for i in range(10)] + [("s0", 99, {"x": 0.0, "y": 1.0}, 9.0, "FAIL")]
    priors = sp.meta_priors(spark.createDataFrame(rows, sp.TRIALS), log=("y",))
    got = {r.param: r for r in priors.collect()}
    assert (got["x"].studies, got["x"].n) == (5, 5) and got["x"].centre == pytest.approx(1.22) and got["y"].centre == pytest.approx(math.log(3))
    places = sp.prior_places(priors, PLANE)
    best = lambda tpe: np.median([sp.sampled(spark, "a", PLANE, bowl, 8, "tpe", seed, tpe=tpe).toPandas().value.max() for seed in range(4)])
    assert best(sp.Tpe(priors=places)) > best(sp.Tpe())


def test_hyperband_equals_brute_force(spark):
    calls = []

    def f(p, budget):
        calls.append(budget)
        return bowl(p) - 1 / budget

    got = sp.hyperband(spark, PLANE, f, most=27, seed=3).toPandas()
    want, drawn, first = [], suggest(PLANE, 27 + 12 + 6 + 4, 3), 0
    for bracket, n in enumerate([27, 12, 6, 4]):
        here = list(range(first, first + n))
        first += n
        for rung in range(4 - bracket):
            budget = 27 / 3 ** (3 - bracket - rung)
            best = sorted(here, key=lambda t: (-(bowl(drawn[t]) - 1 / budget), t))[: len(here) // 3 if rung < 3 - bracket else 0]
            want += [(bracket, rung, t, budget, t in best) for t in here]
            here = sorted(best)
    assert [tuple(r) for r in got[["bracket", "rung", "trial_id", "budget", "kept"]].itertuples(index=False)] == want and len(calls) == len(want)


def test_halving_of_ties_and_nulls(spark):
    rows = [("a", t, k, None if t == 0 else float(t // 2)) for t in range(9) for k in range(3)] + [("b", 1, 0, 1.0)]
    got = sp.halved(spark.createDataFrame(rows, "symbol string, trial_id long, rung int, score double"), ["symbol"], 3, 3).toPandas()
    assert sorted(got[(got.symbol == "a") & (got.rung == 1)].trial_id) == [6, 7, 8] and got[(got.rung == 2)].trial_id.tolist() == [8] and not got[got.symbol == "b"].kept.any()


def series(n, seed=1):
    rng = np.random.default_rng(seed)
    state, out = 0, []
    for _ in range(n):
        state = state if rng.random() < 0.96 else 1 - state
        out.append((state, rng.normal([0.0, 2.0][state], [0.5, 1.5][state])))
    return out


def sequential(x, c):
    """Filter, smoother and likeliest path, row by row."""
    b = np.array([[np.exp(-0.5 * (v - m[0]) ** 2 / s[0, 0]) / np.sqrt(2 * np.pi * s[0, 0]) for m, s in zip(c.mean, c.cov)] for v in x])
    ahead, total = [], 0.0
    for t, row in enumerate(b):
        a = (c.start if t == 0 else ahead[-1] @ c.move) * row
        total += np.log(a.sum())
        ahead.append(a / a.sum())
    back = [np.ones(len(c.start))]
    for row in b[:0:-1]:
        v = c.move @ (row * back[-1])
        back.append(v / v.sum())
    smooth = np.array(ahead) * np.array(back[::-1])
    v, came = np.log(c.start) + np.log(b[0]), []
    for row in b[1:]:
        step = v[:, None] + np.log(c.move)
        came.append(step.argmax(0))
        v = step.max(0) + np.log(row)
    path = [int(v.argmax())]
    for k in came[::-1]:
        path.append(int(k[path[-1]]))
    return np.array(ahead), smooth / smooth.sum(1, keepdims=True), path[::-1], total


@pytest.mark.parametrize("block", [10_000, 12])
def test_chains_equal_the_sequential_filter(spark, block):
    x = {"a": [v for _, v in series(600)], "b": [v for _, v in series(75, 2)]}
    rows = spark.createDataFrame([(s, i, v) for s in x for i, v in enumerate(x[s])] + [("a", 600, None), ("a", 601, math.nan)], "symbol string, row_id long, v double")
    c = ch.Chain(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.1], [1.5]]), np.array([[[0.4]], [[2.0]]]))
    keyed = ch._keyed(rows, ["v"], block)
    got = ch.chain_states(keyed, {"a": c, "b": c}).toPandas().sort_values(["symbol", "row_id"])
    paths = ch.likeliest_states(keyed, {"a": c, "b": c}).toPandas().sort_values(["symbol", "row_id"])
    _, likely = ch._edges(keyed, {"a": c, "b": c})
    for s in x:
        ahead, smooth, path, total = sequential(x[s], c)
        mine = got[got.symbol == s]
        assert np.abs(np.array(mine.filtered.tolist()) - ahead).max() < 1e-9 and np.abs(np.array(mine.smoothed.tolist()) - smooth).max() < 1e-9
        assert paths[paths.symbol == s].state.tolist() == path and likely[s] == pytest.approx(total, abs=1e-7)


def test_switching_regimes_are_found(spark):
    told = series(1500, 5)
    rows = spark.createDataFrame([("a", i, v) for i, (_, v) in enumerate(told)], "symbol string, row_id long, v double")
    one, many = (ch.fit_chains(rows, ["v"], rounds=12, block=b)[0]["a"] for b in (10_000, 100))
    for name in ("start", "move", "mean", "cov"):
        assert getattr(one, name) == pytest.approx(getattr(many, name), rel=1e-6, abs=1e-9)
    assert one.mean.ravel() == pytest.approx([0, 2], abs=0.2) and np.sqrt(one.cov.ravel()) == pytest.approx([0.5, 1.5], abs=0.15) and one.move[0, 0] == pytest.approx(0.96, abs=0.02)
    got = ch.switching_regimes(rows, "v", rounds=12, block=400).toPandas().sort_values("row_id")
    assert np.mean(got.state.values == [s for s, _ in told]) > 0.93
    none = ch.switching_regimes(rows.limit(0), "v")
    assert none.count() == 0


def test_states_within_states(spark):
    rng = random.Random(2)
    told, rows, outer, inner = series(900, 7), [], 0, 0
    for i, (s, v) in enumerate(told):
        inner = inner if rng.random() < 0.95 else rng.randrange(3)
        rows.append(("a|b", i, v, 10.0 * inner + rng.gauss(0, 1)))
    got = ch.hierarchical_states(spark.createDataFrame(rows, "symbol string, row_id long, v double, w double"), "v", "w", rounds=8, block=200).toPandas().sort_values("row_id")
    assert len(got) == 900 and (got.symbol == "a|b").all() and np.mean(got.primary_state.values == [s for s, _ in told]) > 0.9
    assert (got.secondary_state // 3 == got.primary_state).all() and np.mean(got.secondary_state.values % 3 == np.clip(np.round([r[3] / 10 for r in rows]), 0, 2)) > 0.97
    few = ch.hierarchical_states(spark.createDataFrame(rows[:12], "symbol string, row_id long, v double, w double"), "v", "w", rounds=2).toPandas()
    assert (few.secondary_state == few.primary_state * 3).all() and len(few) == 12

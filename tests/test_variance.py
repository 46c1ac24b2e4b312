import numpy as np
import pandas as pd
import pytest

from barwright.operators import variance
from tests.test_blocks import by_symbol


def returns(variant, size, seed, a, b, g):
    """Returns drawn row by row from a model of level 1."""
    rng, state, out = np.random.default_rng(seed), 0.0 if variant == "egarch" else 1.0, np.empty(size)
    for t in range(size):
        h = np.exp(state) if variant == "egarch" else state**2 if variant == "tgarch" else state
        z = rng.normal()
        out[t] = x = np.sqrt(h) * z
        if variant == "egarch":
            state = b * state + a * (abs(z) - variance.SIZE) + g * z
        elif variant == "tgarch":
            state = 1 - b - (a + g / 2) * variance.SIZE + (a + g * (x < 0)) * abs(x) + b * state
        else:
            state = 1 - a - b - g / 2 + (a + g * (x < 0)) * x * x + b * state
    return out


def series(symbol, r):
    close = 100 * np.exp(np.cumsum(0.01 * r))
    return pd.DataFrame({"symbol": symbol, "ts": range(len(r)), "open": close, "high": close, "low": close, "close": close, "volume": 1.0, "a.b": "x"})


def path(r, a, b, g, variant):
    """Row by row with one candidate."""
    h, out = 1.0, []
    for x in r:
        out.append(h)
        if variant == "egarch":
            z = x / np.sqrt(h)
            h = np.exp(b * np.log(h) + a * (abs(z) - variance.SIZE) + g * z)
        elif variant == "tgarch":
            h = (1 - b - (a + g / 2) * variance.SIZE + (a + g * (x < 0)) * abs(x) + b * np.sqrt(h)) ** 2
        else:
            h = 1 - a - b - g / 2 + (a + g * (x < 0)) * x * x + b * h
    return np.array([*out, h])


@pytest.mark.parametrize("variant", variance.VARIANTS)
def test_fit_finds_the_parameters_and_equals_row_by_row(spark, variant):
    true = {"garch": (0.1, 0.8, 0.0), "gjr": (0.04, 0.8, 0.2), "tgarch": (0.08, 0.8, 0.1), "egarch": (0.2, 0.9, -0.15)}[variant]
    frame = pd.concat([series("A", returns(variant, 3000, 3, *true)), series("B", np.zeros(50)), series(None, np.arange(12) % 3)])
    # Blocks of 1,001 rows or one for all: the same candidates win.
    found = by_symbol(variance.variance_model(spark.createDataFrame(frame), variant, before=1000, block=1001))
    once = by_symbol(variance.variance_model(spark.createDataFrame(frame), variant, block=10**6))["A"]
    assert found["B"][f"{variant}_vol"].isna().all() and found["-"][f"{variant}_forecast"].isna().all() and len(found["-"]) == 12
    g = found["A"]
    p = [g[f"{variant}_{c}"][0] for c in ("alpha", "beta", "gamma")]
    np.testing.assert_allclose(p, [once[f"{variant}_{c}"][0] for c in ("alpha", "beta", "gamma")])
    np.testing.assert_allclose(g[f"{variant}_vol"], once[f"{variant}_vol"], rtol=1e-6)
    assert np.abs(np.array(p) - true).max() < 0.08, p
    r = np.r_[0.0, np.diff(np.log(g.close))]
    scale = r.std()
    r = (r - r.mean()) / scale
    h = path(r, *p, variant)
    np.testing.assert_allclose(g[f"{variant}_vol"] ** 2, h[:-1] * scale**2, rtol=1e-6)
    np.testing.assert_allclose(g[f"{variant}_forecast"], h[-1] * scale**2, rtol=1e-6)

    def loss(a, b, c):
        h = path(r, a, b, c, variant)[:-1]
        return (np.log(h) + r * r / h).sum()

    least = loss(*p)
    for i in range(2 if variant == "garch" else 3):
        for s in (-0.01, 0.01):
            q = np.array(p)
            q[i] += s
            if len(variance._valid(q[None], variant)):
                assert loss(*q) > least - 1e-3, (p, i, s)


def test_features_of_missing_rows(spark):
    frame = series("A", returns("garch", 400, 5, 0.1, 0.8, 0.0))
    frame.loc[7, "close"] = np.nan
    out = variance.variance_features(spark.createDataFrame(frame)).orderBy("ts").toPandas()
    assert out.columns.tolist() == [*frame.columns, "garch_vol", "garch_alpha", "garch_beta", "garch_forecast", "egarch_vol", "vol_asymmetry", "vol_of_vol"]
    assert len(out) == 400 and np.isnan(out.garch_vol[7]) and out.garch_vol.notna().sum() == 399
    np.testing.assert_allclose(out.vol_of_vol[100:], out.garch_vol.rolling(20).std()[100:], rtol=1e-9)
    with pytest.raises(ValueError, match="variant"):
        variance.variance_model(spark.createDataFrame(frame), "arch")

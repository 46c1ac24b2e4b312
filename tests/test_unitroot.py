import math

import numpy as np
import pandas as pd
import pytest

from barwright.operators import unitroot
from pyspark.sql import functions as F


def regression(y, x):
    x = np.column_stack([np.ones(len(y)), *x])
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    left = ((y - x @ b) ** 2).sum()
    n = len(y)
    aic = n * math.log(left / n) + 2 * x.shape[1]
    return b[1] / math.sqrt(left / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]), aic


def dickey_fuller(e):
    d = np.diff(e)
    a0, a1 = regression(d[1:], [e[1:-1]])[1], regression(d[1:], [e[1:-1], d[:-1]])[1]
    return regression(d[1:], [e[1:-1], d[:-1]])[0] if a1 < a0 else regression(d, [e[:-1]])[0]


@pytest.mark.parametrize("block", [40, 1000])
def test_cointegration_equals_regressions(spark, block):
    rng = np.random.default_rng(1)
    ref = np.exp(np.cumsum(rng.normal(0, 0.02, 150)) + 4)
    noise = np.convolve(rng.normal(0, 0.01, 151), [1, 0.6])[:150]
    close = ref**0.7 * np.exp(noise)
    close[100:] *= np.exp(np.cumsum(rng.normal(0, 0.05, 50)))
    frame = pd.DataFrame({"symbol": "A", "ts": range(150), "close": close, "ref_close": ref})
    frame.loc[3, "ref_close"] = 0.0
    got = unitroot.cointegration(spark.createDataFrame(frame.sample(frac=1, random_state=2)), 30, block).toPandas().sort_values("ts")
    assert got.coint_stat[got.ts < 34].isna().all()
    for t in range(34, 150):
        y, x = np.log(close[t - 30 : t]), np.log(ref[t - 30 : t])
        b, a = np.polyfit(x, y, 1)
        assert got.coint_stat[got.ts == t].item() == pytest.approx(dickey_fuller(y - a - b * x), rel=1e-6)
    assert got.coint_pvalue[(got.ts >= 40) & (got.ts < 100)].median() < 0.05 < got.coint_pvalue[got.ts > 135].median()


def test_p_values(spark):
    # Published critical values of the two tests.
    known = [(-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)]
    got = spark.createDataFrame([(s,) for s, _ in known] + [(-30.0,), (3.0,), (None,)], "s double").select(unitroot.adf_p(F.col("s"))).collect()
    assert [r[0] for r in got[:3]] == pytest.approx([p for _, p in known], abs=0.002)
    assert [r[0] for r in got[3:]] == [0.0, 1.0, None]
    at = np.linspace(-6, 2.7, 40)
    frame = spark.createDataFrame([(float(s),) for s in at], "s double").select("s", unitroot.adf_p(F.col("s")).alias("p")).orderBy("s").toPandas()
    np.testing.assert_allclose(frame.p, unitroot.adf_p_array(at), atol=1e-12)
    z = unitroot._powers(unitroot.BELOW, -3.0)
    assert unitroot.adf_p_array(np.array([-3.0]))[0] == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-7)
    got = spark.createDataFrame([(s,) for s in (0.1, 0.347, 0.463, 0.5185, 0.739, 5.0, None)], "s double").select(unitroot.kpss_p(F.col("s"))).collect()
    assert [r[0] for r in got[:6]] == pytest.approx([0.1, 0.1, 0.05, 0.0375, 0.01, 0.01]) and got[6][0] is None


def test_stationarity_of_noise_and_walk(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(0, 1, 400)
    frame = pd.concat([pd.DataFrame({"symbol": s, "ts": range(400), "close": v}) for s, v in (("noise", noise), ("walk", np.cumsum(noise)), ("flat", np.ones(400)))])
    got = unitroot.stationarity(spark.createDataFrame(frame)).toPandas().set_index("symbol")
    assert got.adf_stationary["noise"] and got.kpss_stationary["noise"] and not got.conflict["noise"]
    assert not got.adf_stationary["walk"] and not got.kpss_stationary["walk"]
    assert pd.isna(got.adf_stationary["flat"]) and pd.isna(got.conflict["flat"])

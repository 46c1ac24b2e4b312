import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions.student import EXACT, two_sided
from barwright.operators.metrics import trend_test


def tail(t, df):
    """Twice the upper tail by Simpson's rule over the density, in u = atan(x / sqrt(df))."""
    start, steps = math.atan(abs(t) / math.sqrt(df)), 20000
    u = np.linspace(start, math.pi / 2, steps + 1)
    f = np.cos(np.minimum(u, math.pi / 2)) ** (df - 1)
    whole = (u[1] - u[0]) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
    return 2 * whole * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)


def test_probabilities_equal_the_integral(spark):
    cases = [(t, df) for df in (1, 2, 3, 4, 5, 12, 33, EXACT - 1, EXACT, EXACT + 1, 900, 5000) for t in (0.0, 0.4, -1.3, 2.2, 5.0)]
    out = spark.createDataFrame(cases, "t double, df long").withColumn("p", two_sided(F.col("t"), F.col("df"))).collect()
    for r in out:
        assert r.p == pytest.approx(tail(r.t, r.df), abs=1e-9 if r.df <= EXACT else 1e-6), (r.t, r.df)


def test_no_degrees_of_freedom(spark):
    out = spark.createDataFrame([(1.0, 0), (1.0, -1), (None, 3)], "t double, df long").select(two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    assert [r.p for r in out] == [None, None, None]


def test_trends_of_odd_groups(spark):
    rng = np.random.default_rng(2)
    x = np.arange(40.0)
    parts = {"noisy": 0.1 * x + rng.normal(0, 1, 40), "line": 2 * x, "flat": 0 * x + 3}
    frame = pd.concat([pd.DataFrame({"g": k, "x": x, "y": y}) for k, y in parts.items()] + [pd.DataFrame({"g": "two", "x": [1.0, 2.0], "y": [1.0, 5.0]}), pd.DataFrame({"g": "still", "x": [1.0] * 5, "y": [1.0, 2.0, 3.0, 4.0, 5.0]})])
    frame = pd.concat([frame, pd.DataFrame({"g": ["noisy"], "x": [np.nan], "y": [7.0]})])
    df = spark.createDataFrame(frame).replace(float("nan"), None)
    found = {r.g: r for r in trend_test(df, "y", "x", ["g"]).collect()}
    slope, intercept = np.polyfit(x, parts["noisy"], 1)
    rest = parts["noisy"] - intercept - slope * x
    t = slope / math.sqrt((rest @ rest) / 38 / ((x - x.mean()) @ (x - x.mean())))
    assert found["noisy"].n == 40 and found["noisy"].t == pytest.approx(t) and found["noisy"].p_value == pytest.approx(tail(t, 38), abs=1e-9)
    assert found["line"].t is None and found["line"].p_value == 0 and found["line"].slope == pytest.approx(2)
    assert found["two"].p_value is None and found["still"].slope is None and found["still"].p_value is None
    assert found["flat"].slope == 0
    assert trend_test(df.limit(0), "y", "x", ["g"]).count() == 0

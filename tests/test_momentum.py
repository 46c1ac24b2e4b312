import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.operators import blocks, momentum
from barwright.operators.recursive import ema
from tests.test_blocks import by_symbol, near, walk


@pytest.fixture(scope="module")
def bars(spark):
    frame = pd.concat([walk("A", 140, 1), walk("B", 9, 2), walk("C", 90, 3, 40), walk(None, 30, 4)]).sample(frac=1, random_state=5)
    return frame, spark.createDataFrame(frame)


def over_known(x, a):
    """Row by row: the mean of the known values so far, none where the value is unknown."""
    out, last = np.full(len(x), np.nan), None
    for i, v in enumerate(x):
        if not np.isnan(v):
            last = out[i] = v if last is None else last + a * (v - last)
    return out


def placed(x, n):
    s = pd.Series(x)
    low, high = s.rolling(n).min(), s.rolling(n).max()
    return (100 * (s - low) / (high - low).where((high - low).round(6) > 0)).to_numpy()


@pytest.mark.parametrize("block", [7, 1000])
def test_means_go_on_over_unknown_rows(bars, block):
    df = bars[1].withColumn("x", F.when((F.col("ts") > 3) & (F.col("ts") % 5 != 1), F.col("close")))
    out = blocks.exponential_means(df, {"m": ("x", 0.3), "slow": ("x", 0.1)}, block)
    assert out.count() == bars[1].count() and out.columns == [*df.columns, "m", "slow"]
    for g in by_symbol(out).values():
        x = g.x.to_numpy(float)
        near(g.m, over_known(x, 0.3))
        near(g.slow, over_known(x, 0.1))


def test_means_of_no_rows(bars):
    df = bars[1]
    assert momentum.trend_cycle(df.limit(0)).count() == 0
    out = blocks.exponential_means(df.withColumn("x", F.lit(None).cast("double")), {"m": ("x", 0.3)})
    assert out.where("m is not null").count() == 0 and out.count() == df.count()


@pytest.mark.parametrize("block", [11, 1000])
def test_smoothed_indicators_equal_row_by_row(bars, block):
    out = momentum.range_change(momentum.volume_oscillator(momentum.smoothed_force(bars[1], block=block), block=block), 4, block)
    for g in by_symbol(momentum.trend_cycle(out, block=block)).values():
        c, v = g.close.to_numpy(), g.volume.to_numpy()
        near(g.force_ema, over_known(np.diff(c, prepend=np.nan) * v, 2 / 14))
        fast, slow = ema(v, 2 / 13), ema(v, 2 / 27)
        near(g.pvo_hist, 100 * (fast - slow) / slow - ema(100 * (fast - slow) / slow, 2 / 10))
        e = pd.Series(ema(g.high.to_numpy() - g.low.to_numpy(), 2 / 5))
        near(g.cvi, 100 * (e / e.shift(4) - 1))
        d = over_known(placed(ema(c, 2 / 24) - ema(c, 2 / 51), 10), 0.5)
        near(g.stc, over_known(placed(d, 10), 0.5))


def test_sine_wave_follows_a_wave(spark):
    n = 8
    close = [100 + 10 * math.sin(2 * math.pi * i / n) for i in range(40)]
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": range(40), "close": close}))
    out = momentum.sine_wave(df, n).orderBy("ts").toPandas()
    assert out.msw_sine[: n - 1].isna().all()
    late = out[n:]
    # The phase moves by one part in n a row, so sine and lead are one wave, an eighth of a turn apart.
    near(late.msw_sine.to_numpy()[1:], late.msw_lead.to_numpy()[:-1])
    assert abs(late.msw_sine).max() > 0.9


def test_timeframes_name_their_columns(bars):
    out = momentum.by_timeframe(bars[1], (3, 5), ("donchian", "ema", "sma"))
    fresh = [c for c in out.columns if c not in bars[1].columns]
    assert sorted(fresh) == sorted(f"{c}_{n}" for n in (3, 5) for c in ("ema", "sma", "dch", "dcl", "dcm", "dcw", "dcp"))
    for g in by_symbol(out).values():
        near(g.ema_5, ema(g.close.to_numpy(), 2 / 6))
        near(g.dch_3, g.high.rolling(3).max())
    with pytest.raises(ValueError, match="unknown"):
        momentum.by_timeframe(bars[1], (3,), ("nothing",))


def test_every_family_by_timeframe(bars):
    out = momentum.by_timeframe(bars[1].where("symbol = 'A'"), (6,))
    assert {"stoch_rsi_6", "msw_sine_6", "cvi_6", "force_ema_6", "adx_6", "hma_6", "kchi_6"} <= set(out.columns)
    assert out.count() == 140 and len(set(out.columns)) == len(out.columns)


def test_votes_count_silent_columns_and_fill_missing_groups(spark):
    df = spark.createDataFrame([("A", 1, 10.0, 9.0, 30.0, 5.0, 75.0), ("A", 2, 8.0, 9.0, 10.0, 5.0, None)], "symbol string, ts int, close double, sma_5 double, adx_5 double, trend_other double, rsi_5 double")
    a, b = momentum.consensus_by_name(df).orderBy("ts").collect()
    assert a.trend_consensus == pytest.approx(2 / 3) and a.oscillator_consensus == -1 and "volume_consensus" not in a
    assert a.market_consensus == pytest.approx((0.5 * 2 / 3 - 0.3) / 0.8)
    assert b.trend_consensus == pytest.approx(-1 / 3) and b.oscillator_consensus == 0
    assert momentum.consensus_by_name(df.select("symbol", "ts", "close")).columns == ["symbol", "ts", "close"]


def test_standard_scores_by_name(spark):
    df = spark.createDataFrame([("A", i, float(i % 7), 4.0, float(i)) for i in range(12)], "symbol string, ts int, rsi_5 double, cci_5 double, other double")
    out = momentum.standardized_by_name(df, 10).orderBy("ts").toPandas()
    assert [c for c in out.columns if c.startswith("zscore")] == ["zscore_rsi_5", "zscore_cci_5"]
    x = out.rsi_5.rolling(10)
    near(out.zscore_rsi_5[9:], ((out.rsi_5 - x.mean()) / x.std().round(9))[9:])
    assert (out.zscore_cci_5[9:] == 0).all()

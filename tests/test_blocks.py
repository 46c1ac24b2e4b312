import numpy as np
import pandas as pd
import pytest

from barwright.functions.ranges import bin_of, numbered, running_sums
from barwright.operators import blocks, fits, metrics, series
from barwright.operators.recursive import ema
from pyspark.sql import functions as F


def wilder(x, n):
    """Row by row: the mean of the first n known values, then smoothed."""
    out, seen, last = np.full(len(x), np.nan), [], None
    for i, v in enumerate(x):
        if last is not None:
            last = out[i] = (last * (n - 1) + v) / n
        elif not np.isnan(v):
            seen.append(v)
            if len(seen) == n:
                last = out[i] = np.mean(seen)
    return out


def walk(symbol, size, seed, flat=0):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, size))
    close[:flat] = 100.0
    high, low = close + rng.random(size), close - rng.random(size)
    high[:flat], low[:flat] = 101.0, 99.0
    return pd.DataFrame({"symbol": symbol, "ts": range(size), "open": close, "high": high, "low": low, "close": close, "volume": rng.random(size), "a.b": "x", "map": 1})


@pytest.fixture(scope="module")
def bars(spark):
    frame = pd.concat([walk("A", 140, 1), walk("B", 9, 2), walk("C", 90, 3, 40), walk(None, 30, 4)]).sample(frac=1, random_state=5)
    return frame, spark.createDataFrame(frame)


def by_symbol(out):
    out = out.toPandas().sort_values("ts")
    return {k: g.reset_index(drop=True) for k, g in out.groupby(out.symbol.fillna("-"))}


def near(got, want):
    np.testing.assert_allclose(np.asarray(got, float), want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("block", [7, 1000])
def test_means_equal_row_by_row(bars, block):
    for g in by_symbol(blocks.moving_averages(bars[1], block=block)).values():
        c = g.close.to_numpy()
        a, b = ema(c, 2 / 13), ema(c, 2 / 27)
        near(g.ema_fast, a)
        near(g.macd_signal, ema(a - b, 2 / 10))
        three = ema(ema(ema(c, 2 / 16), 2 / 16), 2 / 16)
        near(g.trix[1:], 100 * (three[1:] / three[:-1] - 1))
        step = np.diff(c, prepend=np.nan)
        up, size = ema(ema(step, 2 / 26), 2 / 14), ema(ema(abs(step), 2 / 26), 2 / 14)
        with np.errstate(invalid="ignore", divide="ignore"):
            near(g.tsi, np.where(size == 0, np.nan, 100 * up / size))
        assert list(g["a.b"].unique()) == ["x"]


@pytest.mark.parametrize("block", [5, 1000])
def test_wilder_equals_row_by_row(bars, block):
    for g in by_symbol(blocks.wilder_indicators(bars[1], 6, block)).values():
        c, h, l = (g[x].to_numpy() for x in ("close", "high", "low"))  # noqa: E741
        before, up, down = np.r_[np.nan, c[:-1]], np.diff(h, prepend=np.nan), -np.diff(l, prepend=np.nan)
        true = np.where(np.isnan(before), np.nan, np.fmax.reduce([h - l, abs(h - before), abs(l - before)]))
        atr = wilder(true, 6)
        near(g.atr, atr)
        unknown = np.isnan(up)
        p = 100 * wilder(np.where(unknown, np.nan, np.where((up > down) & (up > 0), up, 0)), 6) / atr
        m = 100 * wilder(np.where(unknown, np.nan, np.where((down > up) & (down > 0), down, 0)), 6) / atr
        with np.errstate(invalid="ignore"):
            dx = 100 * abs(p - m) / (p + m)
        near(g.dx, dx)
        near(g.adx, wilder(dx, 6))
        gain, loss = wilder(np.where(unknown, np.nan, np.maximum(c - before, 0)), 6), wilder(np.where(unknown, np.nan, np.maximum(before - c, 0)), 6)
        with np.errstate(invalid="ignore", divide="ignore"):
            near(g.rsi, np.where(np.isnan(gain), np.nan, np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))))


@pytest.mark.parametrize("block", [8, 1000])
def test_variance_equals_row_by_row(bars, block):
    for g in by_symbol(blocks.garch_filter(bars[1], block=block)).values():
        r = np.r_[0.0, np.diff(np.log(g.close))]
        want, last = [], r.var()
        for v in r:
            want.append(last)
            last = 1e-3 + 0.08 * v * v + 0.9 * last
        near(g.garch_var, want)


def test_windows_equal_in_any_blocks(bars):
    few, many = (by_symbol(series.spectrum(bars[1], 20, b)) for b in (1000, 20))
    for k in few:
        near(many[k].spectral_entropy, few[k].spectral_entropy)
        near(many[k].dominant_power, few[k].dominant_power)
    few, many = (by_symbol(fits.rolling_pca(bars[1], ["high", "low", "volume"], 20, 2, b)) for b in (1000, 23))
    for k in few:
        near(many[k].pca_component_1, few[k].pca_component_1)
        near(many[k].pca_exp_var_ratio_2, few[k].pca_exp_var_ratio_2)


def test_rows_without_prices_take_no_part(spark):
    frame = walk("A", 40, 6)
    frame.loc[[0, 17, 39], "close"] = None
    whole = frame.dropna(subset=["close"])
    df = spark.createDataFrame(frame).replace(float("nan"), None)
    for make in (blocks.moving_averages, lambda d, block: blocks.wilder_indicators(d, 5, block), blocks.garch_filter):
        got = make(df, block=6).toPandas().sort_values("ts").set_index("ts")
        want = make(spark.createDataFrame(whole), block=1000).toPandas().sort_values("ts").set_index("ts")
        made = [c for c in got if c not in frame]
        assert len(got) == 40 and got.loc[[0, 17, 39], made].isna().all().all()
        near(got.loc[want.index, made], want[made].to_numpy(float))
        assert make(df.limit(0), block=6).count() == 0


def test_places_sums_and_bins(spark):
    rng = np.random.default_rng(7)
    key = np.where(rng.random(300) < 0.7, "hot", rng.choice(["a", "b", None], 300))
    frame = pd.DataFrame({"k": key, "v": rng.integers(0, 40, 300).astype(float), "id": range(300)})
    frame.loc[frame.id % 17 == 0, "v"] = None
    frame = frame.astype(object).where(frame.notna(), None)
    df = spark.createDataFrame(list(frame.itertuples(index=False)), "k string, v double, id long")
    df.createOrReplaceTempView("places")
    got = numbered(df, ["k"], ["v", "id"], "n", "t").select("id", "n", "t", bin_of(F.col("n"), F.col("t"), 7).alias("b"))
    want = spark.sql("select id, row_number() over w - 1 as n, count(*) over (partition by k) as t, ntile(7) over w as b from places window w as (partition by k order by v, id)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = running_sums(df.where("v is not null").groupBy("v").agg(F.count("*").alias("c")), "v", ["c"]).orderBy("v").toPandas()
    assert list(got.c_so_far) == list(got.c.cumsum()) and (got.c_total == got.c.sum()).all()
    assert numbered(df.limit(0), ["k"], ["v"], "n").count() == 0


def test_ks_distance_by_ranges(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 30, 200), rng.integers(3, 40, 150)
    frames = (spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double") for x in (a, b))
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in np.r_[a, b])
    assert metrics.ks_statistic(*frames, "x").first()[0] == pytest.approx(want)

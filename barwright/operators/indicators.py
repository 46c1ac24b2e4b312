"""Technical indicators as window expressions. Each function adds columns to a bar table; n is the main period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import series, so_far, lag, ratio, rolling, rows, sma


def _bar() -> tuple[Column, Column, Column, Column, Column]:
    return tuple(F.col(x) for x in ("open", "high", "low", "close", "volume"))


def full(agg: Column, n: int) -> Column:
    return rolling(agg, "close", n)


def hi(n: int) -> Column:
    return full(F.max("high"), n)


def lo(n: int) -> Column:
    return full(F.min("low"), n)


def true_range() -> Column:
    _, H, L, _, _ = _bar()
    return F.greatest(H - L, F.abs(H - lag("close")), F.abs(L - lag("close")))


def prices(df: DataFrame) -> DataFrame:
    """wcprice, typprice, tr, marketfi."""
    _, H, L, C, V = _bar()
    return df.withColumns({"wcprice": (H + L + 2 * C) / 4, "typprice": (H + L + C) / 3, "tr": true_range(), "marketfi": ratio(H - L, V)})


def bollinger(df: DataFrame, n: int = 20) -> DataFrame:
    """Middle, upper and lower band (two population deviations), width, place in the band and outside indicators."""
    _, _, _, C, _ = _bar()
    m, sd = sma("close", n), full(F.stddev_pop("close"), n)
    up, down = m + 2 * sd, m - 2 * sd
    return df.withColumns({"bbm": m, "bbh": up, "bbl": down, "bbw": ratio(4 * sd, m) * 100, "bbp": ratio(C - down, F.when(F.round(sd, 9) > 0, up - down)), "bbhi": F.when(up.isNotNull(), (F.round(C - up, 9) > 0).cast("int")), "bbli": F.when(up.isNotNull(), (F.round(down - C, 9) > 0).cast("int"))})


def donchian(df: DataFrame, n: int = 20) -> DataFrame:
    _, _, _, C, _ = _bar()
    h, l = hi(n), lo(n)  # noqa: E741
    return df.withColumns({"dch": h, "dcl": l, "dcm": (h + l) / 2, "dcw": ratio(h - l, sma("close", n)) * 100, "dcp": ratio(C - l, h - l)})


def keltner(df: DataFrame, n: int = 10) -> DataFrame:
    """Channel of mean typical price plus and minus the mean range, width, place in it and outside indicators."""
    _, H, L, C, _ = _bar()
    m, r = full(F.avg((H + L + C) / 3), n), full(F.avg(H - L), n)
    outside = {"kchi": (F.round(C - (m + r), 9) > 0).cast("int"), "kcli": (F.round((m - r) - C, 9) > 0).cast("int")}
    return df.withColumns({"kcc": m, "kch": m + r, "kcl": m - r, "kcw": ratio(2 * r, m) * 100, "kcp": ratio(C - (m - r), 2 * r), **outside})


def stochastic(df: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    """stoch, its mean, and Williams %R."""
    _, _, _, C, _ = _bar()
    k = ratio(C - lo(n), hi(n) - lo(n)) * 100
    df = df.withColumns({"stoch": k, "willr": ratio(hi(n) - C, hi(n) - lo(n)) * -100})
    return df.withColumn("stoch_signal", rolling(F.avg("stoch"), "stoch", smooth))


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    _, H, L, C, _ = _bar()
    df = df.withColumn("__t", (H + L + C) / 3)
    df = df.withColumns({"__m": sma("__t", n), "__a": F.collect_list("__t").over(rows(n))})
    mad = F.aggregate("__a", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("__m"))) / n
    return df.withColumn("cci", ratio(F.col("__t") - F.col("__m"), F.when(F.round(mad, 9) > 0, 0.015 * mad))).drop("__t", "__m", "__a")


def aroon(df: DataFrame, n: int = 25) -> DataFrame:
    """How recent the highest high and lowest low of n + 1 rows are, the latest of ties."""
    _, H, L, _, _ = _bar()
    df = df.withColumn("__i", F.row_number().over(series()))
    at = lambda x, f: full(f("__i", x), n + 1)
    up = 100 * (n - (F.col("__i") - at(F.struct(H, "__i"), F.max_by))) / n
    down = 100 * (n - (F.col("__i") - at(F.struct(L, -F.col("__i")), F.min_by))) / n
    return df.withColumns({"aroon_up": up, "aroon_down": down, "aroon_ind": up - down}).drop("__i")


def vortex(df: DataFrame, n: int = 14) -> DataFrame:
    _, H, L, _, _ = _bar()
    df = df.withColumns({"__tr": true_range(), "__p": F.abs(H - lag("low")), "__m": F.abs(L - lag("high"))})
    total = lambda x: rolling(F.sum(x), x, n)
    p, m = ratio(total("__p"), total("__tr")), ratio(total("__m"), total("__tr"))
    return df.withColumns({"vortex_pos": p, "vortex_neg": m, "vortex_diff": p - m}).drop("__tr", "__p", "__m")


def ichimoku(df: DataFrame, a: int = 9, b: int = 26, c: int = 52) -> DataFrame:
    mid = lambda n: (hi(n) + lo(n)) / 2
    df = df.withColumns({"ichimoku_conv": mid(a), "ichimoku_base": mid(b), "ichimoku_b": mid(c)})
    df = df.withColumn("ichimoku_a", (F.col("ichimoku_conv") + F.col("ichimoku_base")) / 2)
    return df.withColumns({"visual_ichimoku_a": lag("ichimoku_a", b), "visual_ichimoku_b": lag("ichimoku_b", b)})


def kst(df: DataFrame) -> DataFrame:
    """Know sure thing: weighted means of four rates of change, and its 9-row mean."""
    _, _, _, C, _ = _bar()
    parts = ((10, 10, 1), (15, 10, 2), (20, 10, 3), (30, 15, 4))
    df = df.withColumns({f"__r{i}": ratio(C - lag("close", p), lag("close", p)) for i, (p, _, _) in enumerate(parts)})
    df = df.withColumn("kst", 100 * reduce(lambda a, b: a + b, [w * rolling(F.avg(f"__r{i}"), f"__r{i}", n) for i, (_, n, w) in enumerate(parts)]))
    return df.withColumn("kst_sig", rolling(F.avg("kst"), "kst", 9)).withColumn("kst_diff", F.col("kst") - F.col("kst_sig")).drop(*(f"__r{i}" for i in range(4)))


def money_flow(df: DataFrame, n: int = 14) -> DataFrame:
    """mfi, cmf, cumulative adi, obv, vpt, vwap over n rows, vwma, ease of movement and raw force."""
    _, H, L, C, V = _bar()
    df = df.withColumns({"__t": (H + L + C) / 3, "__clv": F.coalesce(ratio((C - L) - (H - C), H - L), F.lit(0.0)), "__d": C - lag("close"), "__r": ratio(C - lag("close"), lag("close"))})
    df = df.withColumns({"__up": F.when(F.col("__t") > lag("__t"), F.col("__t") * V).otherwise(0.0), "__down": F.when(F.col("__t") < lag("__t"), F.col("__t") * V).otherwise(0.0), "__em": ratio(((H + L) / 2 - (lag("high") + lag("low")) / 2) * (H - L), V)})
    up, down = full(F.sum("__up"), n), full(F.sum("__down"), n)
    return df.withColumns({
        "mfi": F.when(up.isNotNull(), F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))))),
        "cmf": ratio(full(F.sum(F.col("__clv") * V), n), full(F.sum(V), n)), "adi": F.sum(F.col("__clv") * V).over(so_far()),
        "obv": F.sum(F.when(F.col("__d") > 0, V).when(F.col("__d") < 0, -V).otherwise(0.0)).over(so_far()), "vpt": F.sum(F.coalesce(F.col("__r") * V, F.lit(0.0))).over(so_far()),
        "vwap": ratio(full(F.sum(F.col("__t") * V), n), full(F.sum(V), n)), "vwma": ratio(full(F.sum(C * V), n), full(F.sum(V), n)),
        "em": F.col("__em"), "sma_em": rolling(F.avg("__em"), "__em", n), "force": F.col("__d") * V,
    }).drop("__t", "__clv", "__d", "__r", "__up", "__down", "__em")


def volume_index(df: DataFrame, start: float = 1000.0) -> DataFrame:
    """nvi and pvi: growth of the close on bars of falling and of rising volume; wad: Williams accumulation."""
    _, H, L, C, V = _bar()
    r = F.coalesce(ratio(C, lag("close")), F.lit(1.0))
    one = F.lit(1.0)
    df = df.withColumns({"__n": F.when(V < lag("volume"), r).otherwise(one), "__p": F.when(V > lag("volume"), r).otherwise(one), "__w": F.when(C > lag("close"), C - F.least(L, lag("close"))).when(C < lag("close"), C - F.greatest(H, lag("close"))).otherwise(0.0)})
    return df.withColumns({"nvi": start * F.product("__n").over(so_far()), "pvi": start * F.product("__p").over(so_far()), "wad": F.sum("__w").over(so_far())}).drop("__n", "__p", "__w")


def weighted(x: str, n: int) -> Column:
    """Linearly weighted mean: the last row weighs n. A sum over lags stays in one window frame."""
    return F.when(F.count(x).over(rows(n)) == n, reduce(lambda a, b: a + b, [(n - i) * (lag(x, i) if i else F.col(x)) for i in range(n)]) / (n * (n + 1) / 2))


def hull(df: DataFrame, n: int = 16) -> DataFrame:
    """wma and hma: the weighted mean of twice the half-period's less the period's, over the root of n rows."""
    df = df.withColumn("wma", weighted("close", n)).withColumn("__x", 2 * weighted("close", n // 2) - F.col("wma"))
    return df.withColumn("hma", weighted("__x", int(n**0.5))).drop("__x")


def linear_regression(df: DataFrame, n: int = 14) -> DataFrame:
    """linreg (fitted end), linregintercept, linregslope over row numbers, and fosc."""
    _, _, _, C, _ = _bar()
    df = df.withColumn("__i", F.row_number().over(series()).cast("double"))
    slope, mean = full(F.regr_slope(C, F.col("__i")), n), sma("close", n)
    df = df.withColumns({"linregslope": slope, "linregintercept": mean - slope * (n - 1) / 2, "linreg": mean + slope * (n - 1) / 2})
    return df.withColumn("fosc", ratio(100 * (C - (lag("linreg") + lag("linregslope"))), C)).drop("__i")


def oscillators(df: DataFrame, n: int = 14) -> DataFrame:
    """roc, dpo, ao, qstick, vhf, ulcer index, ultimate oscillator, vosc, cumulative and daily return in percent."""
    O, H, L, C, _ = _bar()
    df = df.withColumns({"__a": F.abs(C - lag("close")), "__m": (H + L) / 2, "__bp": C - F.least(L, lag("close")), "__tr": true_range(), "__q": C - O, "__dd": ratio(100 * (C - F.max("close").over(rows(n))), F.max("close").over(rows(n)))})
    share = lambda k: ratio(rolling(F.sum("__bp"), "__bp", k), rolling(F.sum("__tr"), "__tr", k))
    return df.withColumns({
        "roc": ratio(C - lag("close", n), lag("close", n)) * 100, "dpo": lag("close", n // 2 + 1) - sma("close", n), "ao": sma("__m", 5) - sma("__m", 34), "qstick": sma("__q", n),
        "vhf": ratio(full(F.max("close"), n) - full(F.min("close"), n), rolling(F.sum("__a"), "__a", n)), "ui": F.sqrt(full(F.avg(F.col("__dd") * F.col("__dd")), n)),
        "uo": 100 * (4 * share(7) + 2 * share(14) + share(28)) / 7, "vosc": ratio(sma("volume", 5) - sma("volume", n), sma("volume", n)) * 100,
        "others_cr": ratio(C, F.first("close").over(so_far())) * 100 - 100, "others_dr": ratio(C, lag("close")) * 100 - 100,
    }).drop("__a", "__m", "__bp", "__tr", "__q", "__dd")


def candles(df: DataFrame) -> DataFrame:
    """Nine candlestick patterns, each 0 or +-100, from bodies and shadows against the means of the ten bars before."""
    O, H, L, C, _ = _bar()
    body, up, down = F.abs(C - O), H - F.greatest(O, C), F.least(O, C) - L
    df = df.withColumns({"__b": body, "__u": up, "__d": down, "__r": H - L, "__g": (C > O).cast("int") - (C < O).cast("int")})
    df = df.withColumns({"__ab": F.avg("__b").over(rows(10, 1)), "__ar": F.avg("__r").over(rows(10, 1))})
    b, u, d, g, ab, ar = (F.col(f"__{x}") for x in ("b", "u", "d", "g", "ab", "ar"))
    o1, c1, b1, g1, o2, c2, b2, g2, ab1 = lag("open"), lag("close"), lag("__b"), lag("__g"), lag("open", 2), lag("close", 2), lag("__b", 2), lag("__g", 2), lag("__ab")
    flag = lambda cond, v=100: F.when(cond, v).otherwise(0)
    tail = (b < 0.5 * ab) & (d > 2 * b) & (u < 0.1 * ar)
    top = (b < 0.5 * ab) & (u > 2 * b) & (d < 0.1 * ar)
    falling, rising = C < lag("close", 3), C > lag("close", 3)
    inside = (b1 > ab1) & (F.greatest(O, C) < F.greatest(o1, c1)) & (F.least(O, C) > F.least(o1, c1))
    found = {
        "cdl_doji": flag(b <= 0.1 * ar), "cdl_hammer": flag(tail & falling), "cdl_hanging_man": flag(tail & rising, -100), "cdl_shooting_star": flag(top & rising, -100),
        "cdl_engulfing": F.when((g == 1) & (g1 == -1) & (C >= o1) & (O <= c1), 100).when((g == -1) & (g1 == 1) & (O >= c1) & (C <= o1), -100).otherwise(0),
        "cdl_harami": F.when(inside & (g1 == -1), 100).when(inside & (g1 == 1), -100).otherwise(0),
        "cdl_marubozu": F.when((b > ab) & (u < 0.05 * ar) & (d < 0.05 * ar), 100 * g).otherwise(0),
        "cdl_morning_star": flag((g2 == -1) & (b1 < 0.5 * b2) & (g == 1) & (C > (o2 + c2) / 2)), "cdl_evening_star": flag((g2 == 1) & (b1 < 0.5 * b2) & (g == -1) & (C < (o2 + c2) / 2), -100),
    }
    return df.withColumns(found).drop("__b", "__u", "__d", "__r", "__g", "__ab", "__ar")


def consensus(df: DataFrame) -> DataFrame:
    """Trend, oscillator and volume votes in [-1, 1] and their weighted mean; needs sma_20, sma_50, stoch, cci, mfi, cmf.

    Each vote is a mean over its indicators; unknown indicators vote 0.
    """
    _, _, _, C, _ = _bar()
    sign = lambda x: F.coalesce(F.signum(F.round(x, 9)), F.lit(0.0))
    band = lambda x, low, high: F.when(F.round(F.col(x), 9) > high, -1.0).when(F.round(F.col(x), 9) < low, 1.0).otherwise(0.0)
    trend = (sign(C - F.col("sma_20")) + sign(C - F.col("sma_50"))) / 2
    osc = (band("stoch", 20, 80) + band("cci", -100, 100)) / 2
    vol = (band("mfi", 20, 80) + sign(F.col("cmf"))) / 2
    return df.withColumns({"trend_consensus": trend, "oscillator_consensus": osc, "volume_consensus": vol, "market_consensus": 0.5 * trend + 0.3 * osc + 0.2 * vol})


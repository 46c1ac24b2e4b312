"""Features of a target series against a reference series joined by time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import series, so_far, lag, ratio, rolling, rows, safe_ln


def align(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds ref_close: the reference's close on the same ts, carried forward over the target's rows."""
    ref = reference.groupBy("ts").agg(F.max_by("close", F.col("close")).alias("__ref"))
    return df.join(ref, "ts", "left").withColumn("ref_close", F.last("__ref", ignorenulls=True).over(so_far())).drop("__ref")


def relative(df: DataFrame, windows: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """price_ratio, relative_return, and growth over the reference's with its place between the window's extremes."""
    df = df.withColumns({"rt": ratio(F.col("close"), lag("close")) - 1, "rr": ratio(F.col("ref_close"), lag("ref_close")) - 1})
    df = df.withColumns({"price_ratio": ratio(F.col("close"), F.col("ref_close")), "relative_return": F.col("rt") - F.col("rr")})
    both = F.when(F.col("rt").isNotNull() & F.col("rr").isNotNull(), 1)
    df = df.withColumns({f"rel_strength_{w}": F.when(F.count(both).over(rows(w)) == w, ratio(F.product(1 + F.col("rt")).over(rows(w)), F.product(1 + F.col("rr")).over(rows(w)))) for w in windows})
    lo, hi = (lambda w: F.min(f"rel_strength_{w}").over(rows(w))), (lambda w: F.max(f"rel_strength_{w}").over(rows(w)))
    full = lambda w: F.count(f"rel_strength_{w}").over(rows(w)) == w
    return df.withColumns({f"rel_strength_norm_{w}": F.when(full(w) & (F.round(hi(w) - lo(w), 12) > 0), ratio(F.col(f"rel_strength_{w}") - lo(w), hi(w) - lo(w))) for w in windows})


def correlation_beta(df: DataFrame, windows: tuple[int, ...] = (20, 60, 120)) -> DataFrame:
    """Rolling correlation and beta of returns rt on rr where all pairs of the window are complete."""
    both = F.when(F.col("rt").isNotNull() & F.col("rr").isNotNull(), 1)
    out = {}
    for w in windows:
        full = F.count(both).over(rows(w)) == w
        cov, a, b = F.covar_samp("rt", "rr").over(rows(w)), F.stddev_samp("rt").over(rows(w)), F.stddev_samp("rr").over(rows(w))
        out[f"correlation_{w}"] = F.when(full, ratio(cov, a * b))
        out[f"beta_{w}"] = F.when(full, F.regr_slope("rt", "rr").over(rows(w)))
    return df.withColumns(out)


def conditional_beta(df: DataFrame, w: int = 60) -> DataFrame:
    """Beta over the w rows before, apart for rows of high and of low volatility of the reference; ten rows at least."""
    df = df.withColumn("__v", F.round(rolling(F.stddev_samp("rr"), "rr", w), 10))
    median = F.round(F.when(F.count("__v").over(rows(w)) == w, F.percentile("__v", F.lit(0.5)).over(rows(w))), 10)
    df = df.withColumn("__high", F.coalesce(F.col("__v") > median, F.lit(False)))
    both = F.col("rt").isNotNull() & F.col("rr").isNotNull()
    out = {}
    for name, side in (("high", F.col("__high")), ("low", ~F.col("__high"))):
        use = both & side
        n = F.count(F.when(use, 1)).over(rows(w, 1))
        slope = F.regr_slope(F.when(use, F.col("rt")), F.when(use, F.col("rr"))).over(rows(w, 1))
        out[f"beta_{name}vol_{w}"] = F.when((F.row_number().over(series()) > w) & (n >= 10), slope)
    return df.withColumns(out).drop("__v", "__high")


def hedge(df: DataFrame, n: int = 120) -> DataFrame:
    """hedge_ratio and spread_zscore of log prices over the n rows before: residual moments follow from the fit."""
    df = df.withColumns({"__y": safe_ln(F.col("close")), "__x": safe_ln(F.col("ref_close"))})
    f = rows(n, 1)
    full = F.count(F.when(F.col("__y").isNotNull() & F.col("__x").isNotNull(), 1)).over(f) == n
    beta, alpha, r2, var = (g("__y", "__x").over(f) for g in (F.regr_slope, F.regr_intercept, F.regr_r2, lambda y, x: F.var_pop(y)))
    z = ratio(lag("__y") - (alpha + beta * lag("__x")), F.sqrt(F.greatest((1 - r2) * var, F.lit(0.0))))
    return df.withColumns({"hedge_ratio": F.when(full, beta), "spread_zscore": F.when(full, z)}).drop("__y", "__x")


def macro_proxies(df: DataFrame) -> DataFrame:
    """Deterministic rate cycles by row number, and whether the rate rose or fell against ten rows before (circular)."""
    df = df.withColumn("__i", F.row_number().over(series()) - 1)
    days = F.least(F.greatest((F.year("ts") - 2000) * 2 + 230, F.lit(230)), F.lit(252))
    rate = lambda k: F.sin(2 * math.pi * F.col("__i") / days / k)
    df = df.withColumns({"interest_rate_proxy": rate(5) * 2 + 3, "yield_curve_slope_proxy": rate(3)})
    ahead = df.withColumn("__n", F.count("*").over(W.partitionBy("symbol")))
    wrap = ahead.where("__i >= __n - 10").select("symbol", (F.col("__i") - F.col("__n") + 10).alias("__i"), F.col("interest_rate_proxy").alias("__w"))
    df = df.join(wrap, ["symbol", "__i"], "left").withColumn("__b", F.round(F.coalesce(lag("interest_rate_proxy", 10), F.col("__w")), 10))
    now = F.round("interest_rate_proxy", 10)
    return df.withColumns({"tightening_cycle": (now > F.col("__b")).cast("int"), "easing_cycle": (now < F.col("__b")).cast("int")}).drop("__i", "__w", "__b")


def market_flags(df: DataFrame) -> DataFrame:
    """bull_market_proxy, high_vol_regime, high_correlation_regime of the close."""
    df = df.withColumns({"__r": ratio(F.col("close"), lag("close")) - 1, "__i": F.row_number().over(series()) - 1})
    df = df.withColumn("__v", math.sqrt(252) * rolling(F.stddev_samp("__r"), "__r", 20))
    a, b = rolling(F.avg("close"), "close", 100), rolling(F.avg("close"), "close", 200)
    calm = rolling(F.avg("__v"), "__v", 100)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    s = F.sin(2 * math.pi * F.col("__i") / 500)
    return df.withColumns({"bull_market_proxy": flag(F.round(a - b, 6) > 0), "high_vol_regime": flag(F.round(F.col("__v") - calm, 10) > 0), "high_correlation_regime": flag(F.round(s * s, 10) > 0.7)}).drop("__r", "__i", "__v")

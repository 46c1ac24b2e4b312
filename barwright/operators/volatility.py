"""Returns, ranges and volatility estimators. Each function adds columns to a bar table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import series, so_far, whole, lag, rank_pct, ratio, rolling, rows, safe_ln, sma


def returns(df: DataFrame) -> DataFrame:
    """returns, log_returns: against the bar before; null for the first bar or a price that isn't positive."""
    return df.withColumns({"returns": ratio(F.col("close"), lag("close")) - 1, "log_returns": safe_ln(ratio(F.col("close"), F.when(lag("close") > 0, lag("close"))))})


def ranges(df: DataFrame) -> DataFrame:
    """high_low_range, its share of the close, and the bar's Parkinson and Garman-Klass volatility."""
    hl = safe_ln(ratio(F.col("high"), F.when(F.col("low") > 0, F.col("low"))))
    co = F.coalesce(safe_ln(ratio(F.col("close"), F.when(F.col("open") > 0, F.col("open")))), F.lit(0.0))
    gk = 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co
    return df.withColumns({
        "high_low_range": F.col("high") - F.col("low"), "high_low_range_pct": ratio(F.col("high") - F.col("low"), F.col("close")),
        "parkinson_vol": F.sqrt(hl * hl / (4 * math.log(2))), "garman_klass_var": gk, "garman_klass_vol": F.when(F.round(gk, 12) >= 0, F.sqrt(F.abs(gk))),
    })


def rolling_volatility(df: DataFrame, windows: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """Population deviation of log returns (0 for the first) over the last rows, and times the root of 252."""
    r = F.coalesce(F.col("log_returns"), F.lit(0.0))
    found = {f"rolling_vol_{w}": F.stddev_pop(r).over(rows(w)) for w in windows}
    return df.withColumns(found | {f"rolling_vol_annual_{w}": F.stddev_pop(r).over(rows(w)) * math.sqrt(252) for w in windows})


def range_volatility(df: DataFrame, windows: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """Rolling Parkinson and Garman-Klass volatility; needs ranges()."""
    p = F.col("parkinson_vol") * F.col("parkinson_vol")
    found = {f"parkinson_vol_{w}": F.sqrt(F.avg(p).over(rows(w))) for w in windows}
    gk = {w: F.avg("garman_klass_var").over(rows(w)) for w in windows}
    return df.withColumns(found | {f"garman_klass_vol_{w}": F.when(F.round(g, 12) >= 0, F.sqrt(F.abs(g))) for w, g in gk.items()})


def vol_percentile(df: DataFrame, x: str = "rolling_vol_20", n: int = 252) -> DataFrame:
    values = F.collect_list(F.round(x, 10)).over(rows(n))
    return df.withColumn("vol_percentile", F.when(F.count(x).over(rows(n)) == n, rank_pct(values, F.round(x, 10))))


def vol_regime(df: DataFrame, x: str = "vol_percentile") -> DataFrame:
    """Quintile of the percentile over the whole series (0.5 where unknown), by linear-interpolated, right-closed edges."""
    v = F.round(F.coalesce(F.col(x), F.lit(0.5)), 10)
    df = df.withColumn("__e", F.transform(F.percentile(v, F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).over(whole()), lambda e: F.round(e, 10)))
    number = sum((v > F.element_at("__e", i)).cast("int") for i in range(1, 5))
    names = F.array(*map(F.lit, ("very_low", "low", "medium", "high", "very_high")))
    return df.withColumn("vol_regime_numeric", number).withColumn("vol_regime", F.element_at(names, F.col("vol_regime_numeric") + 1)).drop("__e")


def vol_dynamics(df: DataFrame) -> DataFrame:
    """vol_acceleration, vol_deviation from its 20-row mean, and the ratio of the shortest to the longest window."""
    v = F.col("rolling_vol_20")
    return df.withColumns({"vol_acceleration": ratio(v, lag(v, 5)) - 1, "vol_deviation": ratio(v - sma(v, 20), sma(v, 20)), "vol_term_structure": ratio(F.col("rolling_vol_5"), F.col("rolling_vol_60"))})


def vol_seasonality(df: DataFrame, x: str = "rolling_vol_20") -> DataFrame:
    """Mean of x by weekday and by month over the series' mean."""
    parts = {"vol_day_factor": F.weekday("ts"), "vol_month_factor": F.month("ts")}
    df = df.withColumns({f"__{n}": p for n, p in parts.items()})
    from pyspark.sql import Window as W

    return df.withColumns({n: ratio(F.avg(x).over(W.partitionBy("symbol", f"__{n}")), F.avg(x).over(whole())) for n in parts}).drop(*(f"__{n}" for n in parts))


def tail_risk(df: DataFrame, n: int = 252) -> DataFrame:
    """var_95, var_99, cvar_95 and tail_risk_ratio of returns (null counts 0) over n rows.

    cvar_95 is the mean of the n rows before the current one that don't exceed the current var_95; 0 during warm-up.
    """
    df = df.withColumn("__r", F.round(F.coalesce(F.col("returns"), F.lit(0.0)), 10))
    full = F.count("__r").over(rows(n)) == n
    df = df.withColumns({"__l": F.percentile("__r", F.array(F.lit(0.05), F.lit(0.01))).over(rows(n)), "__p": F.collect_list("__r").over(rows(n, 1)), "__s": F.stddev_samp("__r").over(rows(n)), "__f": full})
    var = F.round(F.element_at("__l", 1), 10)
    worst = F.filter("__p", lambda r: r <= var)
    mean = F.aggregate(worst, F.lit(0.0), lambda a, r: a + r) / F.nullif(F.size(worst), F.lit(0))
    df = df.withColumns({"var_95": F.when(F.col("__f"), F.element_at("__l", 1)), "var_99": F.when(F.col("__f"), F.element_at("__l", 2)), "cvar_95": F.when(F.size("__p") == n, mean).otherwise(0.0)})
    return df.withColumn("tail_risk_ratio", F.when(F.col("__f"), ratio(F.col("cvar_95"), F.col("__s")))).drop("__r", "__l", "__p", "__s", "__f")


def drawdown(df: DataFrame) -> DataFrame:
    """Growth of one from returns, its running peak (1 at least) and the drawdown from the peak."""
    df = df.withColumn("growth", F.product(1 + F.coalesce(F.col("returns"), F.lit(0.0))).over(so_far()))
    peak = F.greatest(F.max("growth").over(so_far()), F.lit(1.0))
    return df.withColumn("drawdown", ratio(F.col("growth"), peak) - 1)


def hurst(df: DataFrame, n: int = 100) -> DataFrame:
    """hurst_exponent over the n rows before (0 during warm-up), fractal_dimension, self_similarity.

    Twice the slope of log10 root of the deviation of lagged differences on log10 of the lag, for lags 2 to 19; the
    slope is a fixed linear combination of 18 logs, so no window leaves the JVM.
    """
    lags = list(range(2, 20))
    x = [math.log10(i) for i in lags]
    mean = sum(x) / len(x)
    spread = sum((v - mean) ** 2 for v in x)
    df = df.withColumns({f"__d{i}": F.col("close") - lag("close", i) for i in lags})
    df = df.withColumns({f"__t{i}": F.stddev_pop(f"__d{i}").over(series().rowsBetween(-(n - i), -1)) for i in lags})
    slope = sum((F.lit((v - mean) / spread) * F.log10(F.sqrt(F.when(F.col(f"__t{i}") > 0, F.col(f"__t{i}")))) for i, v in zip(lags, x, strict=True)), F.lit(0.0))
    df = df.withColumn("hurst_exponent", F.when(F.row_number().over(series()) > n, 2 * slope).otherwise(0.0)).drop(*(f"__{k}{i}" for k in "dt" for i in lags))
    h = F.round("hurst_exponent", 10)
    return df.withColumns({"fractal_dimension": 2 - F.col("hurst_exponent"), "self_similarity": F.when(h > 0.5, (F.col("hurst_exponent") - 0.5) * 5).when(h == 0.5, 1.0).otherwise(0.0)})


def permutation_entropy(df: DataFrame, n: int = 100) -> DataFrame:
    """Entropy of order-3 patterns of the n rows before, as a share of its maximum; six counts over one frame."""
    a, b, c = lag("close", 2), lag("close", 1), F.col("close")
    code = F.when((a <= b) & (b <= c), 0).when((a <= c) & (c < b), 1).when((b < a) & (a <= c), 2).when((c < a) & (a <= b), 3).when((b <= c) & (c < a), 4).otherwise(5)
    df = df.withColumn("__c", F.when(a.isNotNull(), code))
    frame = series().rowsBetween(-(n - 2), -1)
    shares = [F.count_if(F.col("__c") == i).over(frame) / (n - 2) for i in range(6)]
    entropy = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares), F.lit(0.0))
    return df.withColumn("perm_entropy", F.when(F.row_number().over(series()) > n, entropy / math.log2(6))).drop("__c")


def spectral_density(df: DataFrame, n: int = 100) -> DataFrame:
    """Sum of squared amplitudes of the n rows before (0 during warm-up), by Parseval's identity without a transform."""
    frame = rows(n, 1)
    df = df.withColumn("__i", F.row_number().over(series())).withColumn("__a", F.when(F.col("__i") % 2 == 0, F.col("close")).otherwise(-F.col("close")))
    s, a, q = F.sum("close").over(frame), F.sum("__a").over(frame), F.sum(F.col("close") * F.col("close")).over(frame)
    return df.withColumn("spectral_density", F.when(F.col("__i") > n, (n * q + s * s + a * a) / 2).otherwise(0.0)).drop("__i", "__a")


def standardized(df: DataFrame, x: str, n: int = 100) -> DataFrame:
    sd = rolling(F.stddev_samp(x), x, n)
    return df.withColumn(f"zscore_{x}", F.when(F.round(sd, 12) == 0, 0.0).otherwise((F.col(x) - sma(x, n)) / F.nullif(sd, F.lit(0.0))))

"""Indicators that smooth other indicators, indicators of several timeframes by name, and votes over columns by name.

Exponential means run by blocks of rows (``blocks.exponential_means``), everything else is a window frame per symbol. What
a scan reads twice is written first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import saved
from ..functions.windows import lag, ratio, rolling, rows, sma
from . import indicators as t
from .blocks import BLOCK, exponential_means, wilder_indicators


def _place(x: str, n: int) -> Column:
    """Place of x between the least and the greatest of n rows, in percent; null where they hardly differ."""
    low, high = rolling(F.min(x), x, n), rolling(F.max(x), x, n)
    return F.when(F.round(high - low, 6) > 0, 100 * (F.col(x) - low) / (high - low))


def smoothed_force(df: DataFrame, n: int = 13, block: int = BLOCK) -> DataFrame:
    """force_ema: exponential mean of the close's change times the volume, from the second row on."""
    df = df.withColumn("__f", (F.col("close") - lag("close")) * F.col("volume"))
    return exponential_means(df, {"force_ema": ("__f", 2 / (n + 1))}, block).drop("__f")


def volume_oscillator(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, block: int = BLOCK) -> DataFrame:
    """pvo, pvo_signal, pvo_hist: difference of two means of the volume in percent of the slow one, its mean, and what is
    left. Rows where the slow mean is 0 have none and do not enter the signal."""
    df = exponential_means(df, {"__f": ("volume", 2 / (fast + 1)), "__s": ("volume", 2 / (slow + 1))}, block)
    df = saved(df.withColumn("pvo", 100 * ratio(F.col("__f") - F.col("__s"), F.col("__s"))).drop("__f", "__s"), "volume_means")
    df = exponential_means(df, {"pvo_signal": ("pvo", 2 / (signal + 1))}, block)
    return df.withColumn("pvo_hist", F.col("pvo") - F.col("pvo_signal"))


def range_change(df: DataFrame, n: int = 10, block: int = BLOCK) -> DataFrame:
    """cvi: change in percent, over n rows, of the exponential mean of the bar's range."""
    df = exponential_means(df.withColumn("__r", F.col("high") - F.col("low")), {"__e": ("__r", 2 / (n + 1))}, block)
    return df.withColumn("cvi", 100 * ratio(F.col("__e") - lag("__e", n), lag("__e", n))).drop("__r", "__e")


def trend_cycle(df: DataFrame, fast: int = 23, slow: int = 50, cycle: int = 10, smooth: int = 3, block: int = BLOCK) -> DataFrame:
    """stc: the difference of two means of the close, placed in its range of ``cycle`` rows and smoothed, twice.

    A row in a range without extent has no place; it does not enter the mean and has no result."""
    a = 2 / (smooth + 1)
    df = exponential_means(df, {"__f": ("close", 2 / (fast + 1)), "__s": ("close", 2 / (slow + 1))}, block)
    df = df.withColumn("__m", F.col("__f") - F.col("__s")).drop("__f", "__s")
    df = exponential_means(saved(df.withColumn("__k", _place("__m", cycle)).drop("__m"), "first_place"), {"__d": ("__k", a)}, block)
    df = saved(df.withColumn("__p", _place("__d", cycle)).drop("__k", "__d"), "second_place")
    return exponential_means(df, {"stc": ("__p", a)}, block).drop("__p")


def stochastic_rsi(df: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    """stoch_rsi, stoch_rsi_k, stoch_rsi_d: place of rsi in its range of n rows, its mean and the mean's mean. Needs rsi."""
    df = df.withColumn("stoch_rsi", _place("rsi", n) / 100)
    df = df.withColumn("stoch_rsi_k", sma("stoch_rsi", smooth))
    return df.withColumn("stoch_rsi_d", sma("stoch_rsi_k", smooth))


def sine_wave(df: DataFrame, n: int = 5) -> DataFrame:
    """msw_sine, msw_lead: sine of the phase of the period of n rows, and the same an eighth of a turn ahead."""
    past = [lag("close", i) if i else F.col("close") for i in range(n)]
    turn = 2 * math.pi / n
    full = F.count("close").over(rows(n)) == n
    real = F.when(full, sum((F.lit(math.cos(turn * i)) * x for i, x in enumerate(past)), F.lit(0.0)))
    imag = F.when(full, sum((F.lit(math.sin(turn * i)) * x for i, x in enumerate(past)), F.lit(0.0)))
    df = df.withColumns({"__re": real, "__im": imag})
    steep = F.when(F.col("__im") < 0, -math.pi / 2).otherwise(math.pi / 2)
    phase = F.when(F.abs("__re") > 0.001, F.atan2("__im", "__re")).when(F.col("__re").isNotNull(), steep)
    df = df.withColumn("__p", phase + math.pi / 2)
    return df.withColumns({"msw_sine": F.sin("__p"), "msw_lead": F.sin(F.col("__p") + math.pi / 4)}).drop("__re", "__im", "__p")


Family = Callable[[DataFrame, int], DataFrame]
FAMILIES: dict[str, Family] = {
    "bollinger": t.bollinger, "donchian": t.donchian, "keltner": t.keltner, "stochastic": t.stochastic, "cci": t.cci, "aroon": t.aroon,
    "vortex": t.vortex, "money_flow": t.money_flow, "linear_regression": t.linear_regression, "oscillators": t.oscillators, "hull": t.hull, "sine_wave": sine_wave,
    "range_change": range_change, "smoothed_force": smoothed_force, "sma": lambda d, n: d.withColumn("sma", sma("close", n)),
    "ema": lambda d, n: exponential_means(d, {"ema": ("close", 2 / (n + 1))}), "wilder": lambda d, n: wilder_indicators(d, n),
    "stochastic_rsi": lambda d, n: stochastic_rsi(saved(wilder_indicators(d, n), "wilder").drop("atr", "dm_plus", "dm_minus", "di_plus", "di_minus", "dx", "adx"), n).drop("rsi"),
}
SCANS = {"range_change", "smoothed_force", "ema", "wilder", "stochastic_rsi"}


def by_timeframe(df: DataFrame, timeframes: Sequence[int], families: Sequence[str] = tuple(FAMILIES)) -> DataFrame:
    """Adds every family's columns for every timeframe n as ``{column}_{n}``. An unknown family is an error.

    Window families share the shuffle by symbol; after families that scan by blocks the rows are written once."""
    if unknown := set(families) - set(FAMILIES):
        raise ValueError(f"unknown families: {sorted(unknown)}")
    for family in sorted(families, key=lambda f: f not in SCANS):  # scans first, as they read their input twice
        for n in timeframes:
            kept = set(df.columns)
            df = FAMILIES[family](df, n)
            df = df.withColumnsRenamed({c: f"{c}_{n}" for c in df.columns if c not in kept})
            if family in SCANS:
                df = saved(df, family)
    return df


#: Column names that count as indicators of a group, as fixed by the votes' definition.
GROUPS = {
    "trend": ("trend_", "adx_", "sma_", "ema_"),
    "oscillator": ("rsi_", "stoch_", "cci_", "mom_"),
    "volume": ("volume_", "obv_", "mfi_", "cmf_"),
}
WEIGHTS = {"trend": 0.5, "oscillator": 0.3, "volume": 0.2}


def _vote(group: str, name: str) -> Column | None:
    """A column's vote, null values vote 0; None for columns without a rule."""
    x = F.round(F.col(f"`{name}`"), 9)
    band = lambda low, high: F.when(x > high, -1.0).when(x < low, 1.0).otherwise(0.0)
    has = lambda *parts: any(p in name for p in parts)
    if group == "trend":
        if has("sma_", "ema_"):
            return F.coalesce(F.signum(F.round(F.col("close") - F.col(f"`{name}`"), 9)), F.lit(0.0))
        return F.when(x > 25, 1.0).otherwise(0.0) if has("adx_") else None
    if group == "oscillator":
        return band(30, 70) if has("rsi_") else band(20, 80) if has("stoch_") else band(-100, 100) if has("cci_") else None
    return band(20, 80) if has("mfi_") else F.coalesce(F.signum(x), F.lit(0.0)) if has("cmf_") else None


def consensus_by_name(df: DataFrame) -> DataFrame:
    """Adds trend_, oscillator_, volume_ and market_consensus from the columns whose names say what they are.

    A group's vote is the sum over its columns divided by their number, also counting columns without a rule (the raw
    ``volume`` has no underscore and isn't one). Groups without columns are left out and the weights of the others fill
    the whole. Votes are in [-1, 1]; a table without any such columns is returned as it is."""
    votes = {}
    for group, parts in GROUPS.items():
        names = [c for c in df.columns if any(p in c for p in parts)]
        if names:
            cast = [v for v in (_vote(group, c) for c in names) if v is not None]
            votes[group] = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sum(cast, F.lit(0.0)) / len(names)))
    if not votes:
        return df
    df = df.withColumns({f"{g}_consensus": v for g, v in votes.items()})
    whole = sum(WEIGHTS[g] for g in votes)
    return df.withColumn("market_consensus", sum((F.col(f"{g}_consensus") * (WEIGHTS[g] / whole) for g in votes), F.lit(0.0)))


#: Prefixes of indicators that get a standard score.
SCORED = ("rsi_", "macd_", "stoch_", "cci_", "mfi_", "willr_")


def standardized_by_name(df: DataFrame, n: int = 100) -> DataFrame:
    """Adds ``zscore_{column}`` over n rows for columns with such a prefix; 0 where n equal values have no deviation."""
    made = {}
    for c in df.columns:
        if c.startswith(SCORED):
            sd = F.round(rolling(F.stddev_samp(F.col(f"`{c}`")), F.col(f"`{c}`"), n), 9)
            made[f"zscore_{c}"] = F.when(sd == 0, 0.0).otherwise(ratio(F.col(f"`{c}`") - sma(F.col(f"`{c}`"), n), sd))
    return df.withColumns(made) if made else df

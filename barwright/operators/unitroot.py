"""Unit roots with p-values: of whole series, and of the spread to a reference over rolling windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import same_keys
from .blocks import BLOCK, over_windows
from .fits import kpss
from .recursive import adf

#: The published response surface of the Dickey-Fuller statistic with a constant, by powers of it, below and
#: above the turn; beyond the ends p is 0 or 1.
TURN, LEAST, MOST = -1.61, -18.83, 2.74
BELOW = (2.1659, 1.4412, 0.038269)
ABOVE = (1.7339, 0.93202, -0.12745, -0.010368)
#: The published table of the level statistic of KPSS and its p.
KPSS_AT = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)
#: The published polynomial of the normal distribution's tail (error under 1e-7).
NORMAL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def _powers(factors, x):
    total = factors[-1]
    for f in reversed(factors[:-1]):
        total = total * x + f
    return total


def _tail(x, exp):
    """The normal distribution's share beyond x, which isn't negative: of arrays and of columns."""
    t = 1 / (1 + 0.2316419 * x)
    return 0.3989422804014327 * exp(-x * x / 2) * t * _powers(NORMAL, t)


def adf_p(stat: Column) -> Column:
    """p of a Dickey-Fuller statistic with a constant."""
    z = F.when(stat <= TURN, _powers(BELOW, stat)).otherwise(_powers(ABOVE, stat))
    beyond = _tail(F.abs(z), F.exp)
    return F.when(stat > MOST, 1.0).when(stat < LEAST, 0.0).when(stat.isNotNull(), F.when(z < 0, beyond).otherwise(1 - beyond))


def adf_p_array(stat: np.ndarray) -> np.ndarray:
    z = np.where(stat <= TURN, _powers(BELOW, stat), _powers(ABOVE, stat))
    beyond = _tail(abs(z), np.exp)
    p = np.where(z < 0, beyond, 1 - beyond)
    return np.where(np.isnan(stat), np.nan, np.where(stat > MOST, 1.0, np.where(stat < LEAST, 0.0, p)))


def kpss_p(stat: Column) -> Column:
    """p of the level statistic between the table's ends of 0.1 and 0.01."""
    out = F.when(stat.isNotNull(), F.lit(KPSS_P[-1]))
    for i in range(len(KPSS_AT) - 2, -1, -1):
        (a, b), (p, q) = KPSS_AT[i : i + 2], KPSS_P[i : i + 2]
        out = F.when(stat <= b, p + (stat - a) / (b - a) * (q - p)).otherwise(out)
    return F.when(stat <= KPSS_AT[0], KPSS_P[0]).otherwise(out)


def stationarity(df: DataFrame, x: str = "close", lags: int = 10, alpha: float = 0.05) -> DataFrame:
    """adf_stat, adf_p, kpss_stat, kpss_p per symbol, what each says (adf_stationary, kpss_stationary) and conflict, where
    they disagree. The Dickey-Fuller test has no lags. A statistic that can't be told is null, and so is what follows."""
    out = same_keys(adf(df, x), kpss(df, x, lags), ["symbol"], "left")
    out = out.withColumns({"adf_p": adf_p(F.col("adf_stat")), "kpss_p": kpss_p(F.col("kpss_stat"))})
    out = out.withColumns({"adf_stationary": F.col("adf_p") < alpha, "kpss_stationary": F.col("kpss_p") >= alpha})
    return out.withColumn("conflict", F.col("adf_stationary") != F.col("kpss_stationary"))


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    """The n values before each one from the n-th on."""
    return np.lib.stride_tricks.sliding_window_view(x, n)[:-1]


def _dickey_fuller(e: np.ndarray) -> np.ndarray:
    """Statistics with a constant of each row's series; a lagged change takes part where Akaike's criterion, on the rows
    that both regressions have, is lower with it."""
    change, level = np.diff(e, axis=1), e[:, :-1]
    centred = lambda a: a - a.mean(1, keepdims=True)
    dot = lambda a, b: (a * b).sum(1)

    def plain(d, u):
        d, u = centred(d), centred(u)
        slope = dot(u, d) / dot(u, u)
        left = dot(d, d) - slope * dot(u, d)
        return slope / np.sqrt(left / (d.shape[1] - 2) / dot(u, u)), left

    d, u, w = (centred(a) for a in (change[:, 1:], level[:, 1:], change[:, :-1]))
    size = d.shape[1]
    ud, wd, uu, ww, uw = dot(u, d), dot(w, d), dot(u, u), dot(w, w), dot(u, w)
    whole = uu * ww - uw * uw
    slope, more = (ud * ww - wd * uw) / whole, (wd * uu - ud * uw) / whole
    left = dot(d, d) - slope * ud - more * wd
    lagged = slope / np.sqrt(left / (size - 3) * ww / whole)
    better = size * np.log(left) + 2 < size * np.log(plain(change[:, 1:], level[:, 1:])[1])
    return np.where(better, lagged, plain(change, level)[0])


def cointegration(df: DataFrame, n: int = 120, block: int = BLOCK) -> DataFrame:
    """coint_stat and coint_pvalue: whether the spread of log prices to the reference (close on ref_close), fitted over
    the n rows before, returns to its mean. Null until there are n rows, and where one of them has no positive prices or
    the reference stands still."""

    def make(d):
        size = len(d["close"])
        stat = np.full(size, np.nan)
        if size > n:
            with np.errstate(all="ignore"):
                y, x = (_windows(np.log(np.where(d[c] > 0, d[c], np.nan)), n) for c in ("close", "ref_close"))
                y, x = y - y.mean(1, keepdims=True), x - x.mean(1, keepdims=True)
                spread = y - ((x * y).sum(1) / (x * x).sum(1))[:, None] * x
                stat[n:] = _dickey_fuller(spread)
        stat[~np.isfinite(stat)] = np.nan
        return {"coint_stat": stat, "coint_pvalue": adf_p_array(stat)}

    return over_windows(df, make, ["coint_stat", "coint_pvalue"], n, ("close", "ref_close"), block, ())

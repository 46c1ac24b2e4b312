"""Fitted models per symbol and tests of stationarity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import series
from .blocks import BLOCK, over_windows
from .recursive import scan


def _variances(r: np.ndarray, omega: float, alpha: float, beta: float, gamma: float) -> np.ndarray:
    out, last = np.empty(len(r)), r.var() + 1e-12
    for i, v in enumerate(r):
        out[i] = last
        last = omega + (alpha + gamma * (v < 0)) * v * v + beta * last
    return out


def garch(df: DataFrame, asymmetric: bool = False) -> DataFrame:
    """garch_vol, garch_alpha, garch_beta, garch_forecast (next variance, a constant column) and garch_gamma of returns.

    Variance targeting leaves alpha and beta (and gamma, the weight of falls) to a likelihood search that halves its
    steps around the best point so far.
    """

    def make(d):
        c = d["close"]
        size = len(c)
        names = ("garch_vol", "garch_alpha", "garch_beta", "garch_gamma", "garch_forecast")
        if size < 30:
            return {n: np.full(size, np.nan) for n in names}
        r = np.r_[0.0, np.diff(np.log(np.maximum(c, 1e-12)))]
        r = (r - r.mean()) / (r.std() or 1.0)

        def loss(p):
            a, b, g = p
            if min(p) < 0 or a + b + g / 2 >= 0.999:
                return math.inf
            h = _variances(r, 1 - a - b - g / 2, a, b, g)
            return float((np.log(h) + r * r / h).sum())

        best, step = np.array([0.05, 0.85, 0.02 if asymmetric else 0.0]), np.array([0.05, 0.1, 0.04 if asymmetric else 0.0])
        low = loss(best)
        while step.max() > 0.005:
            tried = [best + s * step * np.eye(3)[i] for i in range(2 + asymmetric) for s in (-1, 1)]
            costs = [loss(p) for p in tried]
            if min(costs) < low - 1e-9:
                low, best = min(costs), tried[int(np.argmin(costs))]
            else:
                step = step / 2
        a, b, g = best
        scale = np.diff(np.log(np.maximum(c, 1e-12))).var() or 1.0
        h = _variances(r, 1 - a - b - g / 2, a, b, g)
        ahead = 1 - a - b - g / 2 + (a + g * (r[-1] < 0)) * r[-1] ** 2 + b * h[-1]
        return {"garch_vol": np.sqrt(h * scale)} | {n: np.full(size, v) for n, v in zip(names[1:], (a, b, g, ahead * scale), strict=True)}

    return scan(df, make, ["garch_vol", "garch_alpha", "garch_beta", "garch_gamma", "garch_forecast"])


def rolling_pca(df: DataFrame, features: list[str], n: int = 100, components: int = 3, block: int = BLOCK) -> DataFrame:
    """Components of the current row in the directions of the n rows before, and their share of variance.

    Each window stands for itself: features are standardised in it, and a direction's largest loading is positive, so
    results do not depend on where a series starts, and blocks of rows are tasks of their own. Unknown features are 0.
    """
    made = [f"pca_component_{i + 1}" for i in range(components)] + [f"pca_exp_var_ratio_{i + 1}" for i in range(components)]

    def make(d):
        x = np.nan_to_num(np.column_stack([d[f] for f in features]))
        out = np.full((len(x), 2 * components), np.nan)
        for i in range(n, len(x)):
            window = x[i - n : i]
            mean, sd = window.mean(0), window.std(0)
            sd[sd == 0] = 1.0
            values, vectors = np.linalg.eigh(np.cov(((window - mean) / sd).T))
            order = np.argsort(values)[::-1][:components]
            v = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
            out[i, : len(order)] = (x[i] - mean) / sd @ v
            out[i, components : components + len(order)] = values[order] / max(values.sum(), 1e-12)
        return dict(zip(made, out.T, strict=True))

    return over_windows(df, make, made, n, tuple(features), block, ())


def box_cox(df: DataFrame, x: str, grid: int = 41) -> DataFrame:
    """box_cox_<x> with the most likely power among a grid from -2 to 2, where all values are positive; else null.

    The log-likelihood of every power comes from one aggregation over the series.
    """
    powers = [-2 + 4 * i / (grid - 1) for i in range(grid)]
    ln = F.ln(F.when(F.col(x) > 0, F.col(x)))
    shifted = lambda p: ln if abs(p) < 1e-12 else (F.exp(p * ln) - 1) / p
    likely = lambda p: -F.count(x) / 2 * F.ln(F.nullif(F.var_pop(shifted(p)), F.lit(0.0))) + (p - 1) * F.sum(ln)
    best = df.groupBy("symbol").agg(F.min(x).alias("__min"), F.array(*[F.struct(likely(p).alias("l"), F.lit(p).alias("p")) for p in powers]).alias("__l"))
    best = best.select("symbol", F.when(F.col("__min") > 0, F.array_max("__l")["p"]).alias("box_cox_lambda"))
    p = F.col("box_cox_lambda")
    value = F.when(F.abs(p) < 1e-12, F.ln(F.when(F.col(x) > 0, F.col(x)))).otherwise((F.pow(F.when(F.col(x) > 0, F.col(x)), p) - 1) / F.nullif(p, F.lit(0.0)))
    return df.join(best, "symbol").withColumn(f"box_cox_{x}", value)


def kpss(df: DataFrame, x: str = "close", lags: int = 10) -> DataFrame:
    """KPSS level statistic per symbol: squared partial sums over the Bartlett long-run variance of ``lags`` lags."""
    whole = W.partitionBy("symbol")
    rows = df.withColumn("__e", F.col(x) - F.avg(x).over(whole))
    rows = rows.withColumn("__s", F.sum("__e").over(series().rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumns({f"__l{k}": F.lag("__e", k).over(series()) for k in range(1, lags + 1)})
    n = F.count("__e")
    long: Column = F.sum(F.col("__e") ** 2) / n
    for k in range(1, lags + 1):
        long = long + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("__e") * F.col(f"__l{k}")), F.lit(0.0)) / n
    return rows.groupBy("symbol").agg(F.try_divide(F.sum(F.col("__s") ** 2) / (n * n), long).alias("kpss_stat"))


def report(title: str, tables: dict[str, DataFrame], path: str | None = None, rows: int = 50) -> str:
    """A text report of small metric tables, a section each; tables of more than ``rows`` rows say so."""
    out = [title, "=" * len(title)]
    for name, table in tables.items():
        found = table.limit(rows + 1).collect()
        out += ["", name, "-" * len(name), " | ".join(table.columns)]
        out += [" | ".join("n/a" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in found[:rows]]
        if len(found) > rows:
            out.append("... more rows in the table")
    text = "\n".join(out) + "\n"
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text

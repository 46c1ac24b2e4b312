"""Conditional variance models of log returns, fitted over blocks of rows: GARCH, GJR, TGARCH and EGARCH of order one.

A likelihood is a sum over rows, and the weight of the variance at the start of a block's warm-up falls like beta to the
power of the rows since. So every block scores a set of candidates by itself after ``before`` rows of warm-up, the sums
are added per symbol, and the next round searches around each symbol's best. With beta at most 0.98, a warm-up of 1,000
rows leaves 2e-9 of the start.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranges import same_keys
from ..functions.shared import saved
from ..functions.windows import rolling
from .blocks import BLOCK, KEYS, PRICES, Arrays, _all_rows, _append, _read, blocked

VARIANTS = ("garch", "gjr", "tgarch", "egarch")
#: Mean size of a standard normal value.
SIZE = math.sqrt(2 / math.pi)
LEAST_ROWS = 30
MOST_BETA = 0.98


def _valid(p: np.ndarray, variant: str) -> np.ndarray:
    """Candidates (alpha, beta, gamma) with positive variances that return to their level."""
    a, b, g = p.T
    good = (a >= 0) & (b >= 0) & (b <= MOST_BETA)
    if variant == "egarch":
        return p[good & (abs(g) <= 1)]
    weight = (a + g / 2) * (SIZE if variant == "tgarch" else 1)
    return p[good & (a + g >= 0) & (weight + b < 0.999)]


def _lattice(variant: str) -> np.ndarray:
    third = {"garch": (0.0,), "egarch": (-0.15, -0.05, 0.0, 0.05, 0.15)}.get(variant, (0.0, 0.05, 0.15))
    return _valid(np.array(list(product((0.02, 0.06, 0.12, 0.25), (0.3, 0.6, 0.75, 0.85, 0.92, 0.96), third))), variant)


def _around(best: np.ndarray, step: float, variant: str) -> np.ndarray:
    moves = np.array(list(product((-1, 0, 1), (-1, 0, 1), (0,) if variant == "garch" else (-1, 0, 1)))) * step
    return _valid(best + moves * (0.5, 1.0, 0.5), variant)


def variances(r: np.ndarray, p: np.ndarray, variant: str) -> np.ndarray:
    """Variance before each row, and after the last, of standardised returns under every candidate: (rows + 1, candidates).
    They start at 1, the level that the candidates' constants aim at (TGARCH: a mean deviation of 1; EGARCH: a mean
    logarithm of 0)."""
    a, b, g = p.T
    out = np.empty((len(r) + 1, len(p)))
    if variant == "egarch":
        state = np.zeros(len(p))
        for t, x in enumerate(r):
            out[t] = state
            z = x * np.exp(-state / 2)
            state = np.clip(b * state + a * (abs(z) - SIZE) + g * z, -30, 30)
        out[-1] = state
        return np.exp(out)
    state = np.ones(len(p))
    size = abs(r) if variant == "tgarch" else r * r
    level = 1 - b - (a + g / 2) * (SIZE if variant == "tgarch" else 1)
    for t, x in enumerate(size):
        out[t] = state
        state = level + (a + g if r[t] < 0 else a) * x + b * state
    out[-1] = state
    return out * out if variant == "tgarch" else out


def _returns(d: Arrays) -> np.ndarray:
    """Log returns, 0 on the series' first row. In other blocks the first warm-up row has none and is left out."""
    step = np.diff(np.log(np.maximum(d["close"], 1e-12)), prepend=np.nan)
    return np.where(d["n"] == 0, 0.0, step)


def variance_model(df: DataFrame, variant: str = "garch", before: int = 1000, rounds: int = 7, block: int = BLOCK) -> DataFrame:
    """Adds {variant}_vol (deviation of the row's return given those before), {variant}_alpha, _beta, _gamma (weight of
    falls; 0 for garch) and _forecast (variance after the last row), the last four the same on all rows of a symbol.

    A lattice of candidates, then ``rounds`` steps around each symbol's best, halved each time; ties go to the smaller
    parameters. Symbols of under 30 rows or with constant returns, and rows without all of their prices, get nulls."""
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    block = max(block, before + 1)
    rows = saved(blocked(df, block, before + 1, ("close",)), "returns")
    symbol = rows.schema["symbol"]
    params = ("a", "b", "g")

    def moments(table: pa.Table) -> pa.Table:
        table, d, skip = _read(table, ("close",), block)
        r = _returns(d)[skip:]
        made = {"rows": float(len(r)), "mean": float(r.mean()) if len(r) else 0.0, "square": float(((r - r.mean()) ** 2).sum()) if len(r) else 0.0}
        return pa.table({"symbol": table["symbol"].slice(0, 1), "__block": table["__block"].slice(0, 1)} | {k: pa.array([v]) for k, v in made.items()})

    keys = [symbol, T.StructField("__block", T.LongType())]
    kind = T.StructType([*keys, *[T.StructField(c, T.DoubleType()) for c in ("rows", "mean", "square")]])
    blocks = saved(rows.groupBy(*KEYS).applyInArrow(moments, kind), "moments")
    own = blocks.groupBy("symbol").agg(F.sum("rows").alias("count"), (F.sum(F.col("rows") * F.col("mean")) / F.sum("rows")).alias("centre"))
    spread = same_keys(blocks, own, ["symbol"]).groupBy("symbol", "count", "centre")
    spread = spread.agg(F.sqrt(F.sum(F.col("square") + F.col("rows") * (F.col("mean") - F.col("centre")) ** 2) / F.first("count")).alias("scale"))
    best = spread.where(f"count >= {LEAST_ROWS} and scale > 1e-12").select("symbol", "centre", "scale", *[F.lit(0.0).alias(c) for c in params])
    best = saved(best, "scale")

    def dealt(best: DataFrame) -> DataFrame:
        return same_keys(blocks.select(*KEYS), best, ["symbol"])

    def standard(table: pa.Table, found: pa.Table) -> tuple[pa.Table, np.ndarray, int, float]:
        table, d, skip = _read(table, ("close",), block)
        cut = int(d["n"][0] > 0) if len(table) else 0
        r = _returns(d)[cut:]
        scale = found["scale"][0].as_py()
        return table, (r - found["centre"][0].as_py()) / scale, max(skip - cut, 0), scale

    score = T.StructType([symbol, *[T.StructField(c, T.DoubleType()) for c in (*params, "loss")]])

    def scoring(step: float | None):
        def scored(table: pa.Table, found: pa.Table) -> pa.Table:
            if not len(found) or not len(table):
                return pa.table([pa.array([], x) for x in (table.schema.field("symbol").type, *[pa.float64()] * 4)], names=score.names)
            p = _around(np.array([found[c][0].as_py() for c in params]), step, variant) if step else _lattice(variant)
            _, r, skip, _ = standard(table, found)
            h = np.maximum(variances(r, p, variant)[skip:-1], 1e-12)
            loss = (np.log(h) + (r[skip:] ** 2)[:, None] / h).sum(0)
            return pa.table([pa.array([table["symbol"][0].as_py()] * len(p), table["symbol"].type), *p.T.copy(), loss], names=score.names)

        return scored

    for step in (None, *[0.1 / 2**i for i in range(rounds)]):
        losses = rows.groupBy(*KEYS).cogroup(dealt(best).groupBy(*KEYS)).applyInArrow(scoring(step), score)
        losses = losses.groupBy("symbol", *params).agg(F.round(F.sum("loss"), 7).alias("loss"))
        chosen = losses.groupBy("symbol").agg(F.min_by(F.struct(*params), F.struct("loss", *params)).alias("p")).select("symbol", "p.*")
        best = saved(same_keys(best.drop(*params), chosen, ["symbol"]), "best")

    names = [f"{variant}_{c}" for c in ("vol", "alpha", "beta", "gamma")]
    more = [*names, "__next"]
    shape = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in more]])

    def applied(table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(found):
            table, _, skip = _read(table, ("close",), block)
            return _append(table.slice(skip), {c: np.full(len(table) - skip, np.nan) for c in more}, more)
        p = np.array([[found[c][0].as_py() for c in params]])
        table, r, skip, scale = standard(table, found)
        h = variances(r, p, variant)[:, 0] * scale**2
        size = len(r) - skip
        made = {names[0]: np.sqrt(h[skip:-1]), "__next": h[skip + 1 :]} | {c: np.full(size, v) for c, v in zip(names[1:], p[0], strict=True)}
        return _append(table.slice(len(table) - size), made, more)

    made = saved(rows.groupBy(*KEYS).cogroup(dealt(best).groupBy(*KEYS)).applyInArrow(applied, shape), "variances")
    forecast = f"{variant}_forecast"
    made = same_keys(made, made.groupBy("symbol").agg(F.max_by("__next", "__n").alias(forecast)), ["symbol"])
    return _all_rows(df, made, [*names, forecast], PRICES)


def variance_features(df: DataFrame, before: int = 1000, block: int = BLOCK) -> DataFrame:
    """garch_vol, garch_alpha, garch_beta, garch_forecast, vol_of_vol (deviation of garch_vol over 20 rows), egarch_vol and
    vol_asymmetry (EGARCH's gamma)."""
    df = saved(variance_model(df, "garch", before, block=block).drop("garch_gamma"), "garch")
    df = variance_model(df, "egarch", before, block=block).drop("egarch_alpha", "egarch_beta", "egarch_forecast").withColumnRenamed("egarch_gamma", "vol_asymmetry")
    return df.withColumn("vol_of_vol", rolling(F.stddev_samp("garch_vol"), "garch_vol", 20))

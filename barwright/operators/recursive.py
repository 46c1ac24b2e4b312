"""Recursions that no block can summarise, as scans along each symbol's series in one Arrow group; sums of lagged rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import lag, rows as last_rows


def scan(df: DataFrame, make, columns: list[str]) -> DataFrame:
    """Applies ``make(dict of arrays) -> dict of arrays`` to each symbol's bars in the order of ts."""
    fields = df.schema.fields
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + "".join(f", {c} double" for c in columns)

    def run(table):
        table = table.sort_by("ts")
        data = {n: table.column(n).to_numpy(zero_copy_only=False).astype(float) for n in ("open", "high", "low", "close", "volume")}
        made = make(data)
        for c in columns:
            table = table.append_column(c, pa.array(made[c], pa.float64(), from_pandas=True))
        return table

    return df.groupBy("symbol").applyInArrow(run, shape)


def ema(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential mean that starts with the first known value; unknown values carry the mean on."""
    out, last = np.full(len(x), np.nan), np.nan
    for i, v in enumerate(x):
        last = last if np.isnan(v) else v if np.isnan(last) else last + alpha * (v - last)
        out[i] = last
    return out


def _over(a, b):
    return np.divide(a, b, out=np.full(len(a), np.nan), where=(b != 0) & ~np.isnan(b))


def adaptive_averages(df: DataFrame, n: int = 10) -> DataFrame:
    """kama, vidya, zlema, fisher, psar, kvo, chaikin, mass."""

    def make(d):
        c, h, l, v = d["close"], d["high"], d["low"], d["volume"]  # noqa: E741
        size = len(c)
        step = np.r_[0.0, abs(np.diff(c))]
        total = np.cumsum(step)
        kama, vid = np.full(size, np.nan), np.full(size, np.nan)
        gain, fall = np.cumsum(np.r_[0.0, np.maximum(np.diff(c), 0)]), np.cumsum(np.r_[0.0, np.maximum(-np.diff(c), 0)])
        for i in range(n, size):
            noise = total[i] - total[i - n]
            er = abs(c[i] - c[i - n]) / noise if noise else 0.0
            rate = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2
            before = c[i - 1] if i == n else kama[i - 1]
            kama[i] = before + rate * (c[i] - before)
            g, f = gain[i] - gain[i - n], fall[i] - fall[i - n]
            k = abs(g - f) / (g + f) * 2 / (n + 1) if g + f else 0.0
            before = c[i - 1] if i == n else vid[i - 1]
            vid[i] = before + k * (c[i] - before)
        back = (n - 1) // 2
        shifted = np.r_[np.full(back, np.nan), c[: size - back]] if back else c
        fisher, value = np.full(size, np.nan), 0.0
        mid, last = (h + l) / 2, 0.0
        for i in range(n - 1, size):
            lo, hi = mid[i - n + 1 : i + 1].min(), mid[i - n + 1 : i + 1].max()
            value = min(0.999, max(-0.999, 0.66 * ((mid[i] - lo) / (hi - lo) - 0.5 if hi > lo else 0.0) + 0.67 * value))
            fisher[i] = last = 0.5 * np.log((1 + value) / (1 - value)) + 0.5 * last
        psar, rising, rate = np.full(size, np.nan), True, 0.02
        if size:
            at, best = l[0], h[0]
        for i in range(1, size):
            at = at + rate * (best - at)
            at = min(at, l[i - 1]) if rising else max(at, h[i - 1])
            if (rising and l[i] < at) or (not rising and h[i] > at):
                at, rising, rate = best, not rising, 0.02
                best = h[i] if rising else l[i]
            elif (rising and h[i] > best) or (not rising and l[i] < best):
                best, rate = (h[i] if rising else l[i]), min(0.2, rate + 0.02)
            psar[i] = at
        clv = np.nan_to_num(_over((c - l) - (h - c), h - l))
        adl = np.cumsum(clv * v)
        trend = np.sign(np.r_[0.0, np.diff(h + l + c)])
        force = trend * v
        span = ema(h - l, 2 / 10)
        share = _over(span, ema(span, 2 / 10))
        mass = np.convolve(np.nan_to_num(share), np.ones(25))[:size]
        mass[:24] = np.nan
        return {"kama": kama, "vidya": vid, "zlema": ema(2 * c - shifted, 2 / (n + 1)), "fisher": fisher, "psar": psar, "kvo": ema(force, 2 / 35) - ema(force, 2 / 56), "chaikin": ema(adl, 2 / 4) - ema(adl, 2 / 11), "mass": mass}

    return scan(df, make, ["kama", "vidya", "zlema", "fisher", "psar", "kvo", "chaikin", "mass"])


def frac_diff(df: DataFrame, x: str, d: float = 0.4, lags: int = 50, sign: int = 1) -> DataFrame:
    """Fractional difference with ``lags`` weights w_k = sign * w_(k-1) * (d - k + 1) / k, as sums over one window frame;
    sign -1 is the published filter, 1 the literal recursion. Null until all lags are known."""
    w = [1.0]
    for k in range(1, lags):
        w.append(sign * w[-1] * (d - k + 1) / k)
    values = F.reverse(F.collect_list(x).over(last_rows(lags)))
    weights = F.array(*map(F.lit, w))
    total = F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn(f"frac_diff_{x}", F.when(F.count(x).over(last_rows(lags)) == lags, total))


def adf(df: DataFrame, x: str = "close") -> DataFrame:
    """Dickey-Fuller t statistic with a constant and no lags per symbol, from moments of one aggregation."""
    rows = df.withColumns({"__b": lag(x), "__d": F.col(x) - lag(x)}).where("__b is not null and __d is not null")
    m = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.regr_slope("__d", "__b").alias("g"), F.regr_r2("__d", "__b").alias("r2"), F.var_pop("__d").alias("vd"), F.var_pop("__b").alias("vb"))
    error = F.sqrt(F.try_divide((1 - F.col("r2")) * F.col("vd"), (F.col("n") - 2) * F.col("vb")))
    return m.select("symbol", F.try_divide(F.col("g"), error).alias("adf_stat"))

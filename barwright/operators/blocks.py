"""Recursions and windows along long series, a task per block of rows.

Exponential and Wilder means and variance filters are affine: the state after a row is a matrix times the state before
plus a vector. So a block of rows is one matrix and one vector, a symbol's blocks are composed over that small table, and
every block then runs from the state that enters it. Windows of bounded length get the rows before their block instead.

Rows need all of open, high, low, close and volume: others take no part and get nulls.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranges import numbered, same_keys
from ..functions.shared import saved

PRICES = ("open", "high", "low", "close", "volume")
BLOCK = 8192
KEYS = ["symbol", "__block"]
Arrays = dict[str, np.ndarray]


def _whole(names: tuple[str, ...]) -> F.Column:
    known = F.lit(True)
    for c in names:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return known


def blocked(df: DataFrame, block: int, overlap: int, names: tuple[str, ...] = PRICES, need: tuple[str, ...] = PRICES) -> DataFrame:
    """symbol, ts, the named columns and ``__row``, all of the row, for rows that have all of ``need``; with ``__n``, their
    place from 0 in the symbol's series, and ``__block``. The last ``overlap`` rows of a block also come to the next one,
    before its own rows."""
    if not 0 <= overlap <= block:
        raise ValueError("a block must hold the overlap")
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("__row")
    rows = numbered(df.where(_whole(need)).select("symbol", "ts", *names, row), ["symbol"], ["ts"], "__n")
    b = F.floor(F.col("__n") / block)
    ahead = F.col("__n") % block >= block - overlap
    return rows.withColumn("__block", F.explode(F.when(ahead, F.array(b, b + 1)).otherwise(F.array(b))))


def _with(df: DataFrame, columns: list[str]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in columns]])


def _read(table: pa.Table, names: tuple[str, ...], block: int) -> tuple[pa.Table, Arrays, int]:
    """The block's rows in order, the named columns with ``n``, and how many rows come from the block before."""
    table = table.sort_by("__n")
    data = {c: table[c].to_numpy(zero_copy_only=False).astype(float) for c in names}
    data["n"] = table["__n"].to_numpy(zero_copy_only=False).astype(np.int64)
    first = table["__block"][0].as_py() * block if len(table) else 0
    return table, data, int((data["n"] < first).sum())


def _append(table: pa.Table, made: Arrays, columns: list[str]) -> pa.Table:
    for c in columns:
        table = table.append_column(c, pa.array(np.asarray(made[c], float), pa.float64(), from_pandas=True))
    return table


def _all_rows(df: DataFrame, made: DataFrame, columns: list[str], names: tuple[str, ...]) -> DataFrame:
    """The blocks' rows and, with nulls, those that took no part."""
    rest = df.where(~_whole(names)).withColumns({c: F.lit(None).cast("double") for c in columns})
    return made.select("__row.*", *columns).unionByName(rest)


def over_windows(df: DataFrame, make: Callable[[Arrays], Arrays], columns: list[str], before: int, names: tuple[str, ...] = PRICES, block: int = BLOCK, need: tuple[str, ...] = PRICES) -> DataFrame:
    """Applies ``make(arrays) -> arrays`` to blocks of rows that start with the ``before`` rows ahead of them, for values
    that depend on no earlier row. The series' first rows have nothing ahead of them. need: columns that rows must have."""
    block = max(block, before)
    rows = blocked(df, block, before, names, need)

    def run(table: pa.Table) -> pa.Table:
        table, data, skip = _read(table, names, block)
        return _append(table, make(data), columns).slice(skip)

    return _all_rows(df, rows.groupBy(*KEYS).applyInArrow(run, _with(rows, columns)), columns, need)


Step = Callable[[Arrays], tuple[np.ndarray, np.ndarray]]
Finish = Callable[[Arrays, np.ndarray, np.ndarray], Arrays]


def linear_scan(rows: DataFrame, step: Step, size: int, finish: Finish, columns: list[str], names: tuple[str, ...] = PRICES, block: int = BLOCK) -> DataFrame:
    """Runs state = m[t] @ state + v[t] along each symbol's rows, which ``blocked`` has dealt.

    step: gives m (rows, size, size) and v (rows, size) for the arrays of a block; the first row of a series must not
    depend on the state. finish: makes the columns from the block's arrays, the states before and the states after each
    row; where rows come from the block before, all three are without them. Rows are shuffled by block, twice; a block's
    matrix is all that meets those of the symbol's other blocks.
    """
    key = T.StructType([rows.schema["symbol"], T.StructField("__block", T.LongType())])
    summary = T.StructType([*key.fields, T.StructField("map", T.BinaryType())])
    kind = summary.names

    def summed(table: pa.Table) -> pa.Table:
        table, data, skip = _read(table, names, block)
        m, v = step(data)
        p = np.hstack([np.eye(size), np.zeros((size, 1))])
        for t in range(skip, len(v)):
            p = m[t] @ p
            p[:, -1] += v[t]
        return pa.table([table["symbol"].slice(0, 1), table["__block"].slice(0, 1), pa.array([p.tobytes()], pa.binary())], names=kind)

    def composed(table: pa.Table) -> pa.Table:
        table = table.sort_by("__block")
        state, out = np.zeros(size), []
        for data in table["map"]:
            out.append(state.tobytes())
            p = np.frombuffer(data.as_py()).reshape(size, size + 1)
            state = p[:, :-1] @ state + p[:, -1]
        return pa.table([table["symbol"], table["__block"], pa.array(out, pa.binary())], names=kind)

    def run(table: pa.Table, enters: pa.Table) -> pa.Table:
        table, data, skip = _read(table, names, block)
        m, v = step(data)
        state = np.frombuffer(enters["map"][0].as_py())
        states = np.empty((len(v) - skip + 1, size))
        states[0] = state
        for t in range(skip, len(v)):
            state = states[t - skip + 1] = m[t] @ state + v[t]
        own = {c: x[skip:] for c, x in data.items()}
        return _append(table.slice(skip), finish(own, states[:-1], states[1:]), columns)

    enters = saved(rows.groupBy(*KEYS).applyInArrow(summed, summary).groupBy("symbol").applyInArrow(composed, summary), "entering")
    return rows.groupBy(*KEYS).cogroup(enters.groupBy(*KEYS)).applyInArrow(run, _with(rows, columns))


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=(b != 0) & ~np.isnan(b))


def _step_of(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.nan)


def moving_averages(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, block: int = BLOCK) -> DataFrame:
    """ema_fast, ema_slow, macd, macd_signal, macd_diff, ppo, trix, tsi. Means start with the first value."""
    f, s, g, t, d, e = (2 / (n + 1) for n in (fast, slow, signal, 15, 25, 13))
    # State: fast, slow, signal, three means of means, two of changes and two of their sizes. A mean of means takes the
    # new state of the mean before it: new = keep * old + feed @ new + take @ (close, change, size of change).
    keep = np.diag([1 - f, 1 - s, 1 - g, 1 - t, 1 - t, 1 - t, 1 - d, 1 - e, 1 - d, 1 - e])
    feed, take = np.zeros((10, 10)), np.zeros((10, 3))
    feed[2, 0], feed[2, 1], feed[4, 3], feed[5, 4], feed[7, 6], feed[9, 8] = g, -g, t, t, e, e
    take[0, 0], take[1, 0], take[3, 0], take[6, 1], take[8, 2] = f, s, t, d, d
    solved = np.linalg.inv(np.eye(10) - feed)
    move, put = solved @ keep, solved @ take

    def step(data: Arrays) -> tuple[np.ndarray, np.ndarray]:
        c, n = data["close"], data["n"]
        change = np.nan_to_num(_step_of(c))
        v = np.column_stack([c, change, abs(change)]) @ put.T
        m = np.broadcast_to(move, (len(c), 10, 10))
        if len(n) and n[0] <= 1:
            m = m.copy()
            first, second = n == 0, n == 1
            m[first] = 0
            v[first] = 0
            v[np.ix_(first, [0, 1, 3, 4, 5])] = c[first][:, None]
            m[np.ix_(second, [6, 7, 8, 9])] = 0
            v[np.ix_(second, [6, 7])] = change[second][:, None]
            v[np.ix_(second, [8, 9])] = abs(change[second])[:, None]
        return m, v

    def finish(data: Arrays, before: np.ndarray, after: np.ndarray) -> Arrays:
        a, b, line, three = after[:, 0], after[:, 1], after[:, 2], after[:, 5]
        later = data["n"] > 0
        last = np.where(later, before[:, 5], np.nan)
        ratio = np.where(later, _over(after[:, 7], after[:, 9]), np.nan)
        return {"ema_fast": a, "ema_slow": b, "macd": a - b, "macd_signal": line, "macd_diff": a - b - line, "ppo": 100 * _over(a - b, b), "trix": 100 * (_over(three, last) - 1), "tsi": 100 * ratio}

    columns = ["ema_fast", "ema_slow", "macd", "macd_signal", "macd_diff", "ppo", "trix", "tsi"]
    return _all_rows(df, linear_scan(blocked(df, block, 1), step, 10, finish, columns, block=block), columns, PRICES)


def exponential_means(df: DataFrame, means: dict[str, tuple[str, float]], block: int = BLOCK) -> DataFrame:
    """Adds exponential means: {name: (column, weight of the new value)}. They start with the first row that knows all of the
    columns; rows that lack one take no part, so the mean goes on over them, and have none."""
    names = tuple(dict.fromkeys(c for c, _ in means.values()))
    weights = np.array([w for _, w in means.values()])

    def step(d: Arrays) -> tuple[np.ndarray, np.ndarray]:
        first, x = (d["n"] == 0)[:, None], np.column_stack([d[c] for c, _ in means.values()])
        m = np.zeros((*x.shape, len(weights)))
        i = np.arange(len(weights))
        m[:, i, i] = np.where(first, 0.0, 1 - weights)
        return m, np.where(first, x, weights * x)

    def finish(d: Arrays, _: np.ndarray, after: np.ndarray) -> Arrays:
        return dict(zip(means, after.T, strict=True))

    rows = blocked(df, block, 0, names, names)
    return _all_rows(df, linear_scan(rows, step, len(weights), finish, list(means), names, block), list(means), names)


def _wilder(x: np.ndarray, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and terms of Wilder's mean: rank counts the known values up to each row. The n-th closes their mean; later
    rows smooth, and an unknown value there leaves no mean."""
    known = ~np.isnan(x)
    growing, closing = rank < n, known & (rank == n)
    factor = np.where(growing, 1.0, np.where(closing, 1 / n, (n - 1) / n))
    return factor, np.where(growing, np.nan_to_num(x), x / n)


def wilder_indicators(df: DataFrame, n: int = 14, block: int = BLOCK) -> DataFrame:
    """atr, rsi, dm_plus, dm_minus, di_plus, di_minus, dx, adx."""
    first = ["atr", "rsi", "dm_plus", "dm_minus", "di_plus", "di_minus", "dx"]

    def step(d: Arrays) -> tuple[np.ndarray, np.ndarray]:
        before = np.r_[np.nan, d["close"][:-1]] if len(d["close"]) else d["close"]
        change, up, down = _step_of(d["close"]), _step_of(d["high"]), -_step_of(d["low"])
        true = np.fmax.reduce([d["high"] - d["low"], abs(d["high"] - before), abs(d["low"] - before)])
        plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        made = [true, np.fmax(change, 0), np.fmax(-change, 0), plus, minus]
        m, v = np.zeros((len(change), 5, 5)), np.zeros((len(change), 5))
        for i, x in enumerate(made):
            m[:, i, i], v[:, i] = _wilder(np.where(d["n"] == 0, np.nan, x), d["n"], n)
        m[d["n"] == 0] = 0
        return m, v

    def finish(d: Arrays, _: np.ndarray, after: np.ndarray) -> Arrays:
        atr, gain, loss, p, m = np.where(d["n"][:, None] < n, np.nan, after).T
        plus, minus = 100 * _over(p, atr), 100 * _over(m, atr)
        rsi = np.where(loss == 0, 100.0, 100 - 100 / (1 + _over(gain, loss)))
        return {"atr": atr, "rsi": np.where(np.isnan(gain), np.nan, rsi), "dm_plus": p, "dm_minus": m, "di_plus": plus, "di_minus": minus, "dx": 100 * _over(abs(plus - minus), plus + minus)}

    # The mean of dx starts where its n-th known value is, so blocks are told how many come before them.
    rows = saved(linear_scan(blocked(df, block, 1), step, 5, finish, first, block=block), "directions")
    counts = rows.groupBy(*KEYS).agg(F.count("dx").alias("__k"))
    line = W.partitionBy("symbol").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    counts = counts.select(*KEYS, F.coalesce(F.sum("__k").over(line), F.lit(0)).alias("__known"))

    def again(d: Arrays) -> tuple[np.ndarray, np.ndarray]:
        m, v = _wilder(d["dx"], d["__known"] + np.cumsum(~np.isnan(d["dx"])), n)
        return m[:, None, None], v[:, None]

    def adx(d: Arrays, _: np.ndarray, after: np.ndarray) -> Arrays:
        return {"adx": np.where(d["__known"] + np.cumsum(~np.isnan(d["dx"])) < n, np.nan, after[:, 0])}

    rows = linear_scan(same_keys(rows, counts, KEYS), again, 1, adx, ["adx"], ("dx", "__known"), block)
    return _all_rows(df, rows, [*first, "adx"], PRICES)


def garch_filter(df: DataFrame, omega: float = 1e-3, alpha: float = 0.08, beta: float = 0.9, block: int = BLOCK) -> DataFrame:
    """garch_var: conditional variance of log returns with given parameters, h = omega + alpha r^2 + beta h before. It
    starts with the variance of all the symbol's returns, the first row's being 0."""

    def returns(table: pa.Table) -> pa.Table:
        table, data, skip = _read(table, ("close",), block)
        ln = np.log(np.maximum(data["close"], 1e-12))
        return _append(table, {"__r": np.where(data["n"] == 0, 0.0, _step_of(ln))}, ["__r"]).slice(skip)

    rows = blocked(df, block, 1)
    rows = saved(rows.groupBy(*KEYS).applyInArrow(returns, _with(rows, ["__r"])), "returns")
    rows = same_keys(rows, rows.groupBy("symbol").agg(F.var_pop("__r").alias("__h")), ["symbol"])

    def step(d: Arrays) -> tuple[np.ndarray, np.ndarray]:
        start = d["n"] == 0
        v = omega + alpha * d["__r"] ** 2 + np.where(start, beta * d["__h"], 0.0)
        return np.where(start, 0.0, beta)[:, None, None], v[:, None]

    def finish(d: Arrays, before: np.ndarray, _: np.ndarray) -> Arrays:
        return {"garch_var": np.where(d["n"] == 0, d["__h"], before[:, 0])}

    return _all_rows(df, linear_scan(rows, step, 1, finish, ["garch_var"], ("__r", "__h"), block), ["garch_var"], PRICES)

"""Row frames per symbol and guarded window aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series() -> W:
    """A symbol's rows in the order of ts."""
    return W.partitionBy("symbol").orderBy("ts")


def whole() -> W:
    return W.partitionBy("symbol")


def rows(n: int, skip: int = 0) -> W:
    """The last ``n`` rows; with ``skip`` 1 those before the current one."""
    return series().rowsBetween(-(n - 1) - skip, -skip)


def so_far() -> W:
    return series().rowsBetween(W.unboundedPreceding, 0)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rolling(agg: Column, x: str | Column, n: int) -> Column:
    """An aggregate over the last ``n`` rows, null until ``x`` has ``n`` values there."""
    return F.when(F.count(col(x)).over(rows(n)) == n, agg.over(rows(n)))


def sma(x: str | Column, n: int) -> Column:
    return rolling(F.avg(col(x)), x, n)


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(col(x), n).over(series())


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def rank_pct(values: Column, x: Column) -> Column:
    """Average-tie rank of x among an array of values, as a share."""
    less = F.size(F.filter(values, lambda v: v < x))
    same = F.size(F.filter(values, lambda v: v == x))
    return (less + (same + 1) / 2) / F.size(values)


def row_number() -> Column:
    return F.row_number().over(series())


def rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """symbol, ts and the named columns, doubles rounded and NaN as null."""
    kinds = dict(df.dtypes)
    out = [F.round(F.when(~F.isnan(n), F.col(n)), digits).alias(n) if kinds[n] in ("double", "float") else F.col(n) for n in names]
    return df.select("symbol", "ts", *out)

"""Places, running sums and bins over a sort by ranges: each task holds one range of the order, never all rows.

A window without partitions, or with one long series, sorts all its rows in one task. Here rows are parted by ranges of
the order and written once; only the ranges' own counts or sums, one row each, meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import saved


def ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows sorted by ranges of ``keys`` and written, with ``__part`` and ``__at``, which rises along a range."""
    rows = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return saved(rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranges")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null, with the columns of ``a`` and the further ones of ``b``."""
    right = b.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return a.join(right, on, how).drop(*[f"__r_{k}" for k in keys])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, total: str | None = None) -> DataFrame:
    """Adds ``name``, the place from 0 of each row in its group ``by`` in the order of ``order``, and ``total``, the rows
    of its group. Nulls come first and are a group of their own; rows that tie get places in any order. A group with most
    of the rows is many ranges, so many tasks."""
    rows = ranged(df, [*by, *order])
    parts = rows.groupBy(*by, "__part").agg(F.count("*").alias("__k"), F.min("__at").alias("__first"))
    group = W.partitionBy(*by)
    before = F.coalesce(F.sum("__k").over(group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = {"__before": before} | ({total: F.sum("__k").over(group)} if total else {})
    rows = same_keys(rows, parts.withColumns(found).drop("__k"), [*by, "__part"])
    return rows.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__before", "__first")


def running_sums(df: DataFrame, order: str, sums: list[str]) -> DataFrame:
    """Adds ``<x>_so_far`` and ``<x>_total`` of each column in ``sums``, in the order of ``order``."""
    rows = ranged(df, [order])
    parts = rows.groupBy("__part").agg(*[F.sum(x).alias(f"__{x}") for x in sums])
    line = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    found = {f"__{x}_before": F.coalesce(F.sum(f"__{x}").over(line), F.lit(0)) for x in sums} | {f"{x}_total": F.sum(f"__{x}").over(W.partitionBy()) for x in sums}
    rows = rows.join(F.broadcast(parts.withColumns(found).drop(*[f"__{x}" for x in sums])), "__part")
    inside = W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"{x}_so_far": F.col(f"__{x}_before") + F.sum(x).over(inside) for x in sums})
    return rows.drop("__part", "__at", *[f"__{x}_before" for x in sums])


def bin_of(place: Column, total: Column, bins: int) -> Column:
    """The bin from 1 of a place from 0 when ``bins`` bins are filled as equally as can be, the first ones fuller."""
    size, more = F.floor(total / bins), total % bins
    full = more * (size + 1)
    return F.when(place < full, F.floor(place / (size + 1))).otherwise(more + F.floor((place - full) / F.greatest(size, F.lit(1)))) + 1

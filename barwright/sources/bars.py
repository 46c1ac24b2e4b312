"""Bar tables (symbol, ts, open, high, low, close, volume) made from event, order and shipment tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OhlcvColumns:
    """Names of the bar columns in a source table."""

    symbol: str | None = None
    ts: str = "date"
    open: str = "Open"
    high: str = "High"
    low: str = "Low"
    close: str = "Close"
    volume: str | None = "Volume"


def canonical(df: DataFrame, names: OhlcvColumns = OhlcvColumns(), symbol: str = "ALL") -> DataFrame:
    """Projects a table to the canonical bar columns; dates that can't be read become null."""
    ts = F.col(names.ts)
    if dict(df.dtypes)[names.ts] == "string":
        ts = F.try_to_timestamp(ts)
    volume = F.col(names.volume) if names.volume else F.lit(None)
    prices = [F.col(getattr(names, x)).cast("double").alias(x) for x in ("open", "high", "low", "close")]
    return df.select((F.col(names.symbol) if names.symbol else F.lit(symbol)).alias("symbol"), ts.alias("ts"), *prices, volume.cast("double").alias("volume"))


def aggregate_bars(df: DataFrame, symbol: Column, ts: Column, price: Column, order: Column, volume: Column) -> DataFrame:
    """One bar per symbol and ts: first and last price by ``order``, extremes and volume. One shuffle, combined map-side."""
    return df.groupBy(symbol.alias("symbol"), ts.alias("ts")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), volume.cast("double").alias("volume")
    )


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type's values."""
    e = read(spark, sf_dir, "events")
    return aggregate_bars(e, F.col("event_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), F.col("value"), F.col("ts"), F.count("*"))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals, one symbol."""
    o = read(spark, sf_dir, "orders")
    return aggregate_bars(o, F.lit("ORD"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), F.count("*"))


def ship_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line prices, one symbol: the reference asset."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return aggregate_bars(l, F.lit("SHP"), F.col("l_shipdate"), F.col("l_extendedprice"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.sum("l_quantity"))


def quantity_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line quantities, one symbol: another reference asset."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return aggregate_bars(l, F.lit("QTY"), F.col("l_shipdate"), F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.sum("l_quantity"))


def tick_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line prices by supplier in the order of shipment: a wide panel of short series. ``ts`` is the order key."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    price = F.col("l_extendedprice")
    return l.select(F.col("l_suppkey").cast("string").alias("symbol"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("ts"), price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"), F.col("l_quantity").alias("volume"))

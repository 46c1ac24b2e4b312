"""Prediction samples: a target, a simple forecast and their context, from daily order bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import series, whole, lag, ratio, rolling, rows
from .bars import order_bars


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id from 0, ts, y (return of the bar), yhat (mean of five returns before), vol (20-row deviation of returns),
    batch_id of 64 rows, volume and regime by volatility and momentum; rows before the first vol are left out."""
    df = order_bars(spark, sf_dir).withColumn("y", ratio(F.col("close"), lag("close")) - 1)
    df = df.withColumns({"yhat": F.round(F.avg("y").over(rows(5, 1)), 10), "vol": F.round(rolling(F.stddev_pop("y"), "y", 20), 10), "mom": F.round(rolling(F.avg("y"), "y", 20), 10), "y": F.round("y", 10)})
    df = df.where("vol is not null").withColumn("row_id", F.row_number().over(series()).cast("long") - 1)
    high = F.col("vol") > F.round(F.percentile("vol", F.lit(0.7)).over(whole()), 10)
    regime = F.when(high & (F.col("mom") > 0), 1).when(high, 2).when(F.col("mom") > 0, 3).otherwise(4)
    return df.withColumns({"batch_id": (F.col("row_id") / 64).cast("long"), "regime": regime}).select("symbol", "row_id", "ts", "y", "yhat", "vol", "mom", "volume", "batch_id", "regime")

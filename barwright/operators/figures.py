"""Tables behind figures: a metric over time with its trend, by regime, and the most important features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import forecast_metrics, trend_test

#: Names of regimes, as fixed by the figure.
REGIMES = {0: "Normal", 1: "Bullish Volatile", 2: "Bearish Volatile", 3: "Bullish Stable", 4: "Bearish Stable"}


def _long(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return df.select(*by, F.inline(pairs))


def decay_figure(df: DataFrame, metrics: list[str], parts: int = 5) -> DataFrame:
    """Per symbol, part of its time and metric: value, slope over the parts, the trend line that starts at the first
    value, and the slope's p_value. Rows without a forecast take no part; a single row is part 1."""
    w = W.partitionBy("symbol")
    df = df.where("yhat is not null").withColumns({"__i": F.row_number().over(w.orderBy("row_id")) - 1, "__n": F.count("*").over(w)})
    place = F.ceil(F.round(F.try_divide(F.col("__i") * parts, F.col("__n") - 1), 9))
    df = df.withColumn("part", F.greatest(F.lit(1), F.coalesce(place, F.lit(1))).cast("int")).drop("__i", "__n")
    values = _long(forecast_metrics(df, ["symbol", "part"]), ["symbol", "part"], metrics)
    trend = trend_test(values, "value", "part", ["symbol", "metric"]).select("symbol", "metric", "slope", "p_value")
    values = values.alias("v").join(trend.alias("t"), F.col("v.symbol").eqNullSafe(F.col("t.symbol")) & (F.col("v.metric") == F.col("t.metric")), "left")
    values = values.select("v.symbol", "part", "v.metric", "value", "slope", "p_value")
    first = F.first("value").over(W.partitionBy("symbol", "metric").orderBy("part"))
    return values.withColumn("trend", first + F.col("slope") * (F.col("part") - F.min("part").over(W.partitionBy("symbol", "metric"))))


def regime_figure(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Per regime and metric: the regime's name and the value over all symbols. Other numbers are named by number."""
    names = F.create_map(*[F.lit(x) for kv in REGIMES.items() for x in kv])
    values = _long(forecast_metrics(df, ["regime"]), ["regime"], metrics)
    name = F.coalesce(F.try_element_at(names, F.col("regime").cast("int")), F.concat(F.lit("Regime "), F.col("regime").cast("string")))
    return values.withColumn("regime_name", name)


def importance_figure(importances: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` features by mean importance over folds, with its deviation and rank; ties by name. Needs feature and
    importance, a row for each fold."""
    means = importances.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"))
    best = means.orderBy(F.desc_nulls_last(F.round("mean", 12)), "feature").limit(top)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last(F.round("mean", 12)), "feature")))

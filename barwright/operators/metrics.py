"""Risk, return and forecast metrics as aggregates. ``by`` columns group the rows; none is one group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranges import running_sums
from ..functions.student import two_sided

ROOT = math.sqrt(252)


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def strategy(df: DataFrame, costs_bps: float = 3.0) -> DataFrame:
    """strat (sign of the forecast times the return) and strat_net (less costs of each change of the forecast)."""
    w = W.partitionBy("symbol").orderBy("row_id")
    cost = F.abs(F.col("yhat") - F.coalesce(F.lag("yhat").over(w), F.lit(0.0))) * costs_bps / 1e4
    df = df.withColumn("strat", F.coalesce(F.signum("yhat"), F.lit(0.0)) * F.col("y"))
    return df.withColumn("strat_net", F.col("strat") - F.coalesce(cost, F.lit(0.0)))


def risk_metrics(df: DataFrame, r: str, by: list[str], tail: float = 5.0) -> DataFrame:
    """sharpe, sortino, annualized volatility, max drawdown, calmar, cvar, gain to pain of a return column, by group.

    Growth and its peak are windows over row_id; the worst returns are those ranked up to the rounded-up share.
    """
    p = W.partitionBy(*by)
    line = p.orderBy("row_id").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("__g", F.product(1 + F.col(r)).over(line)).withColumn("__k", F.row_number().over(p.orderBy(r, "row_id")))
    df = df.withColumns({"__dd": F.col("__g") / F.greatest(F.max("__g").over(line), F.lit(1.0)) - 1, "__cut": F.ceil(F.count(r).over(p) * tail / 100), "__neg": F.least(F.col(r), F.lit(0.0))})
    agg = df.groupBy(*by).agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"), F.avg(F.col("__neg") ** 2).alias("down"), F.min("__dd").alias("mdd"), F.product(1 + F.col(r)).alias("total"), F.avg(F.when(F.col("__k") <= F.col("__cut"), F.col(r))).alias("cvar"), F.sum(r).alias("s"), F.sum(-F.col("__neg")).alias("pain"))
    mdd = F.least(F.col("mdd"), F.lit(0.0))
    cagr = F.pow("total", 252 / F.col("n")) - 1
    return agg.select(*by, _ratio(F.col("m"), F.col("sd")).alias("__s"), *[F.col(x) for x in ("n", "m", "sd", "down", "cvar", "s", "pain")], mdd.alias("max_drawdown"), cagr.alias("cagr")).select(
        *by, (F.col("__s") * ROOT).alias("sharpe"), (_ratio(F.col("m") * 252, F.sqrt("down") * ROOT)).alias("sortino"), (F.col("sd") * ROOT).alias("annual_volatility"), "max_drawdown",
        F.when(F.round("max_drawdown", 12) < 0, _ratio(F.col("cagr"), F.abs("max_drawdown"))).alias("calmar"), "cvar", _ratio(F.col("s"), F.col("pain")).alias("gain_to_pain"),
    )


def forecast_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """rmse, mae, r2, mda, information ratio, direction accuracy and strategy sharpe with population deviation, by group."""
    w = W.partitionBy(*by).orderBy("row_id")
    step = lambda x: F.signum(F.col(x) - F.coalesce(F.lag(x).over(w), F.lit(0.0)))
    df = df.where("yhat is not null").withColumns({"__e": F.col("y") - F.col("yhat"), "__same": (step("y") == step("yhat")).cast("double"), "__n": F.lead("y").over(w) * F.signum("yhat")})
    agg = df.groupBy(*by).agg(F.avg(F.col("__e") ** 2).alias("mse"), F.avg(F.abs("__e")).alias("mae"), F.var_pop("y").alias("v"), F.avg("__same").alias("mda"), F.avg("__n").alias("sm"), F.stddev_pop("__n").alias("ss"), F.avg((F.signum("y") == F.signum("yhat")).cast("double")).alias("direction_accuracy"), F.avg("__e").alias("am"), F.stddev_samp("__e").alias("asd"), F.covar_pop("y", "yhat").alias("cov"), F.stddev_pop("y").alias("sy"), F.stddev_pop("yhat").alias("sp"))
    return agg.select(*by, F.sqrt("mse").alias("rmse"), "mae", (1 - _ratio(F.col("mse"), F.col("v"))).alias("r2"), "mda", "direction_accuracy", (F.col("sm") / (F.col("ss") + 1e-10) * ROOT).alias("sharpe"), _ratio(F.col("am"), F.col("asd")).alias("information_ratio"), _ratio(F.col("cov"), F.col("sy") * F.col("sp")).alias("ic"))


def average_rank(x: str, by: list[str]) -> Column:
    p = W.partitionBy(*by)
    return F.rank().over(p.orderBy(x)) + (F.count("*").over(W.partitionBy(*by, x)) - 1) / 2


def rank_correlation(df: DataFrame, by: list[str]) -> DataFrame:
    """Spearman's correlation of forecast and target: Pearson's of average ranks."""
    df = df.where("yhat is not null and y is not null").withColumns({"__a": average_rank("y", by), "__b": average_rank("yhat", by)})
    return df.groupBy(*by).agg(_ratio(F.covar_pop("__a", "__b"), F.stddev_pop("__a") * F.stddev_pop("__b")).alias("rank_correlation"))


def regime_consistency(df: DataFrame, r: str = "y") -> DataFrame:
    """One less the deviation over the mean of the regimes' Sharpe ratios, within 0 and 1."""
    by = df.groupBy("regime").agg(_ratio(F.avg(r), F.stddev_samp(r)).alias("s"))
    score = F.lit(1) - _ratio(F.stddev_pop("s"), F.abs(F.avg("s")))
    return by.agg(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)).alias("regime_consistency"))


def summary(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Mean, population deviation, extremes, median, outer percentiles, interquartile range and variation by group."""
    q = F.percentile(x, F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    agg = df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), q.alias("q"))
    at = lambda i: F.element_at("q", i)
    return agg.select(*by, "mean", "std", "min", "max", at(3).alias("median"), at(1).alias("p5"), at(5).alias("p95"), (at(4) - at(2)).alias("iqr"), _ratio(F.col("std"), F.col("mean")).alias("cv"))


def ks_statistic(a: DataFrame, b: DataFrame, x: str) -> DataFrame:
    """Largest distance of two empirical distributions: running shares over ranges of the union's distinct
    values."""
    both = a.select(F.col(x).alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r")).union(b.select(F.col(x).alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    steps = both.where("v is not null").groupBy("v").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    rows = running_sums(steps, "v", ["l", "r"])
    return rows.agg(F.max(F.abs(_ratio(F.col("l_so_far"), F.col("l_total")) - _ratio(F.col("r_so_far"), F.col("r_total")))).alias("ks"))


def out_of_distribution(df: DataFrame, by: list[str]) -> DataFrame:
    """Forecast metrics of unseen rows and the risk metrics of trading on them, one row a group."""
    forecast = forecast_metrics(df, by).withColumnRenamed("sharpe", "forecast_sharpe")
    return forecast.join(risk_metrics(strategy(df), "strat", by), by)


def parameter_stability(sets: DataFrame) -> DataFrame:
    """One minus the mean coefficient of variation of the parameters that all sets have, within 0 and 1. Parameters with a
    zero mean are left out; one set is fully stable, none is not, and neither are sets without such a parameter in common."""
    n = sets.agg(F.count("*").alias("sets"))
    by = sets.select(F.explode("params").alias("param", "x")).groupBy("param")
    by = by.agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    cv = by.select("n", F.when(F.col("m") != 0, F.col("sd") / F.abs("m")).alias("cv"))
    mean = n.join(cv, (F.col("n") == F.col("sets")), "left").groupBy("sets").agg(F.avg("cv").alias("mean_cv"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("mean_cv", F.lit(1.0))))
    return mean.select(F.when(F.col("sets") == 0, 0.0).when(F.col("sets") == 1, 1.0).otherwise(score).alias("stability"))


def trend_test(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Per group: n, slope and intercept of y over x, r2, slope_error, t and its two-sided p_value.

    Rows that lack either take no part. Under three rows, or without spread of x, there is no test; on an exact line t is
    null and p_value 0."""
    df = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    fit = {"n": F.count("*"), "slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "r2": F.regr_r2(y, x), "__y": F.var_pop(y), "__x": F.var_pop(x)}
    df = df.groupBy(*by).agg(*[v.alias(k) for k, v in fit.items()])
    free = F.col("n") - 2
    error = F.when(free > 0, F.sqrt(_ratio(F.greatest(1 - F.col("r2"), F.lit(0.0)) * F.col("__y"), free * F.col("__x"))))
    df = df.withColumn("slope_error", error).withColumn("t", _ratio(F.col("slope"), F.when(F.round(1 - F.col("r2"), 12) > 0, F.col("slope_error"))))
    exact = (free > 0) & (F.round(1 - F.col("r2"), 12) <= 0)
    return df.withColumn("p_value", F.when(exact, 0.0).otherwise(two_sided(F.col("t"), free))).drop("__y", "__x")

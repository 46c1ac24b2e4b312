"""Features of regimes and of several families together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import rank_pct, rolling, rows, series
from . import calendar, crossasset, recursive, variance, volatility
from .regimes import rolling_mode, transition_matrix


def _frame(n: int, order: str) -> W:
    return W.partitionBy("symbol").orderBy(order).rowsBetween(-(n - 1), 0)


def regime_inputs(df: DataFrame, r: str = "y", n: int = 20, order: str = "row_id") -> DataFrame:
    """Adds volatility, cum_return, skew (bias-corrected) and sharpe over ``n`` rows; the warm-up takes the first known
    value, a ratio without volatility is 0."""
    w = _frame(n, order)
    full = F.count(r).over(w) == n
    skew = F.skewness(r).over(w) * F.lit((n * (n - 1)) ** 0.5 / (n - 2))
    made = {"volatility": F.stddev_samp(r).over(w), "cum_return": F.sum(r).over(w), "skew": skew}
    df = df.withColumns({k: F.when(full, v) for k, v in made.items()})
    ahead = W.partitionBy("symbol").orderBy(order).rowsBetween(0, W.unboundedFollowing)
    df = df.withColumns({k: F.first(k, ignorenulls=True).over(ahead) for k in made})
    return df.withColumn("sharpe", F.coalesce(F.try_divide("cum_return", "volatility"), F.lit(0.0)))


def clustering_regimes(df: DataFrame, r: str = "y", k: int = 3, seed: int = 42) -> DataFrame:
    """Adds ``regime_cluster``: k-means over two principal components of the scaled regime inputs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    v = VectorAssembler(inputCols=["volatility", "cum_return", "skew", "sharpe"], outputCol="__raw", handleInvalid="skip").transform(regime_inputs(df, r))
    v = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True).fit(v).transform(v)
    v = PCA(k=2, inputCol="__scaled", outputCol="__pc").fit(v).transform(v)
    v = KMeans(k=k, seed=seed, featuresCol="__pc", predictionCol="__c").fit(v).transform(v)
    names = v.groupBy("__c").agg(F.avg("volatility").alias("m"))
    names = names.select("__c", (F.row_number().over(W.orderBy("m", "__c")) - 1).alias("regime_cluster"))
    return v.drop("__raw", "__scaled", "__pc").join(names, "__c").drop("__c")


def transition_model(df: DataFrame, features: list[str], state: str = "regime", order: str = "row_id", rounds: int = 100, seed: int = 42) -> DataFrame:
    """Adds ``changes`` (the next row has another state; the last row looks at the first) and ``change_probability`` of
    boosted trees."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    w = W.partitionBy("symbol").orderBy(order)
    following = F.coalesce(F.lead(state).over(w), F.first(state).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rows = df.withColumn("changes", (following != F.col(state)).cast("double"))
    v = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(rows)
    model = GBTClassifier(featuresCol="__x", labelCol="changes", maxIter=rounds, stepSize=0.05, maxDepth=3, seed=seed)
    v = model.fit(v).transform(v)
    return v.withColumn("change_probability", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")


def regime_features(df: DataFrame, state: str, states: list[int]) -> DataFrame:
    """Adds the rolling modes of a state and ``trans_prob_{from}_to_{to}``: the probability of that step where the row is
    in ``from``, else 0."""
    table = transition_matrix(df, state).groupBy("symbol").agg(
        *[F.max(F.when((F.col("from_state") == a) & (F.col("to_state") == b), F.col("prob"))).alias(f"__p{a}_{b}") for a in states for b in states]
    )
    rows = rolling_mode(df, state).join(table, "symbol")
    made = {f"trans_prob_{a}_to_{b}": F.when(F.col(state) == a, F.coalesce(F.col(f"__p{a}_{b}"), F.lit(0.0))).otherwise(0.0) for a in states for b in states}
    return rows.withColumns(made).drop(*[f"__p{a}_{b}" for a in states for b in states])


def nearest_fill(df: DataFrame, label: str, order: str = "row_id") -> DataFrame:
    """Fills a label from the nearest row that has one; of two equally near ones the earlier."""
    w = W.partitionBy("symbol").orderBy(order)
    at = F.when(F.col(label).isNotNull(), F.struct(F.col(order).alias("at"), F.col(label).alias("x")))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    near = F.when(after["at"].isNull() | (F.col(order) - before["at"] <= after["at"] - F.col(order)), before["x"]).otherwise(after["x"])
    return df.withColumn(f"{label}_filled", near)


def adaptive_average(df: DataFrame, base: int = 20, least: int = 5, most: int = 50) -> DataFrame:
    """Adds adaptive_timeframe, which grows with the rank of the true range's share of the price among 50 rows, and
    adaptive_sma, the mean close of as many rows. Needs atr."""
    df = df.withColumn("__a", F.round(F.try_divide("atr", "close"), 12))
    seen = F.collect_list("__a").over(rows(most))
    rank = F.when((F.col("__a").isNotNull()) & (F.count("__a").over(rows(most)) == most), rank_pct(seen, F.col("__a")))
    length = F.greatest(F.least(F.coalesce(F.bround(F.round(base * (1 + rank), 9), 0), F.lit(base)), F.lit(most)), F.lit(least)).cast("int")
    df = df.withColumn("adaptive_timeframe", length).withColumn("__i", F.row_number().over(series()))
    closes = F.collect_list("close").over(rows(most))
    take = F.least("__i", "adaptive_timeframe")
    mean = F.round(F.aggregate(F.slice(closes, -take, take), F.lit(0.0), lambda a, x: a + x), 6) / take
    return df.withColumn("adaptive_sma", F.when(F.col("__i") > least, mean)).drop("__a", "__i")


def vol_of_vol(df: DataFrame, n: int = 20) -> DataFrame:
    """Adds vol_of_vol: the deviation of the filtered volatility over ``n`` rows. Needs garch_var."""
    df = df.withColumn("__v", F.sqrt("garch_var"))
    return df.withColumn("vol_of_vol", rolling(F.stddev_samp("__v"), "__v", n)).drop("__v")


def volatility_features(df: DataFrame, models: bool = False) -> DataFrame:
    """All volatility families in one chain of frames over one shuffle by symbol; with ``models`` also the fitted variances."""
    v = volatility
    if models:
        df = variance.variance_features(df)
    df = v.vol_seasonality(v.vol_dynamics(v.vol_regime(v.vol_percentile(v.range_volatility(v.ranges(v.rolling_volatility(v.returns(df))))))))
    return v.hurst(v.drawdown(v.tail_risk(df)))


def calendar_features(df: DataFrame, intraday: bool = False, more_holidays: DataFrame | None = None) -> DataFrame:
    """Date parts, cycles, effects and holidays; with ``intraday`` also times of the session and the volume's rank in its
    hour. more_holidays: a table with a column ``day``, further days that count as holidays with the days around them."""
    c = calendar
    df = c.holidays(c.effects(c.cyclical(c.parts(df))))
    if more_holidays is not None:
        df = c.more_holidays(df, more_holidays)
    return c.volume_percentile(c.intraday(df)) if intraday else df


def cross_asset_features(df: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """Relative strength, correlation and beta against each reference, named ``{feature}_vs_{asset}``."""
    for asset, reference in references.items():
        kept = df.columns
        made = crossasset.correlation_beta(crossasset.relative(crossasset.align(df, reference)))
        fresh = [c for c in made.columns if c not in kept]
        df = made.select(*kept, *[F.col(c).alias(f"{c}_vs_{asset}") for c in fresh])
    return df


def cross_asset_family(df: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """``cross_asset_features`` with betas by volatility, hedge ratio and spread of each reference, named alike, and the
    target's own macro proxies and market flags."""
    for asset, reference in references.items():
        kept = df.columns
        made = crossasset.hedge(crossasset.conditional_beta(crossasset.correlation_beta(crossasset.relative(crossasset.align(df, reference)))))
        fresh = [c for c in made.columns if c not in kept]
        df = made.select(*kept, *[F.col(c).alias(f"{c}_vs_{asset}") for c in fresh])
    return crossasset.market_flags(crossasset.macro_proxies(df))


def transformations(df: DataFrame, target: str = "close") -> DataFrame:
    """The target's logarithm, standard score and fractional difference."""
    df = recursive.frac_diff(volatility.standardized(df, target), target)
    return df.withColumn(f"log_{target}", F.when(F.col(target) > 0, F.ln(target)))

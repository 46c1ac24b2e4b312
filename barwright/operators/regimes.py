"""Regimes, transitions and feature selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranges import bin_of, numbered, same_keys
from ..functions.windows import rows


def transition_matrix(df: DataFrame, state: str, order: str = "row_id") -> DataFrame:
    """(symbol, from_state, to_state, prob) for all pairs of states; a state never left is uniform."""
    w = W.partitionBy("symbol").orderBy(order)
    moves = df.select("symbol", F.col(state).alias("from_state"), F.lead(state).over(w).alias("to_state")).where("to_state is not null")
    counts = moves.groupBy("symbol", "from_state", "to_state").agg(F.count("*").alias("n"))
    states = df.select("symbol", F.col(state).alias("s")).distinct().groupBy("symbol").agg(F.sort_array(F.collect_set("s")).alias("all"))
    pairs = states.select("symbol", F.size("all").alias("k"), F.explode("all").alias("from_state"), "all").select("symbol", "k", "from_state", F.explode("all").alias("to_state"))
    full = pairs.join(counts, ["symbol", "from_state", "to_state"], "left")
    total = F.sum("n").over(W.partitionBy("symbol", "from_state"))
    return full.select("symbol", "from_state", "to_state", F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), total), 1 / F.col("k")).alias("prob"))


def rolling_mode(df: DataFrame, state: str, windows: tuple[int, ...] = (20, 50)) -> DataFrame:
    """The most frequent state of the last rows, the smallest of ties."""
    out = {}
    for n in windows:
        values = F.collect_list(state).over(rows(n))
        out[f"regime_mode_{n}"] = values
    df = df.withColumns(out)

    def mode(values):
        tally = F.transform(F.array_distinct(values), lambda s: F.struct((-F.size(F.filter(values, lambda v: v == s))).alias("n"), s.alias("s")))
        return F.array_min(tally)["s"]

    return df.withColumns({name: mode(F.col(name)) for name in out})


def segments(df: DataFrame, is_break: F.Column, order: str = "row_id") -> DataFrame:
    """regime_id: breaks so far less one, not under 0 (the first two segments share 0); segment_id counts all."""
    n = F.sum(is_break.cast("int")).over(W.partitionBy("symbol").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("segment_id", n).withColumn("regime_id", F.greatest(n - 1, F.lit(0)))


def kmeans_regimes(df: DataFrame, features: list[str], k: int = 4, seed: int = 42) -> DataFrame:
    """Clusters of standardised features by MLlib's k-means; labels are renumbered by the first feature's mean."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    v = VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="skip").transform(df)
    v = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(v).transform(v)
    v = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="__c").fit(v).transform(v).drop("__raw", "__x")
    order = v.groupBy("__c").agg(F.avg(features[0]).alias("m")).withColumn("regime_kmeans", F.row_number().over(W.orderBy("m", "__c")) - 1)
    return v.join(F.broadcast(order.drop("m")), "__c").drop("__c")


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 5) -> DataFrame:
    """Mutual information of equally filled bins of each feature and of the target, ties in the order of row_id.

    A long table of all columns is sorted once by ranges, so bins are places in it and no task holds a whole column; row_id
    and, if there is one, symbol tell rows apart.
    """
    keys = [c for c in ("symbol", "row_id") if c in df.columns]
    kinds = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in dict.fromkeys((*features, target))]
    long = df.select(*keys, F.explode(F.array(*kinds)).alias("x")).select(*keys, "x.*")
    binned = numbered(long, ["feature"], ["v", *reversed(keys)], "n", "rows").select(*keys, "feature", bin_of(F.col("n"), F.col("rows"), bins).alias("b"))
    of_target = binned.where(F.col("feature") == target).select(*keys, F.col("b").alias("t"))
    joint = same_keys(binned.where(F.col("feature").isin(features)), of_target, keys).groupBy("feature", "b", "t").agg(F.count("*").alias("n"))
    p = lambda *c: F.sum("n").over(W.partitionBy("feature", *c))
    terms = joint.select("feature", (F.col("n") / p() * F.ln(F.col("n") * p() / (p("b") * p("t")))).alias("term"))
    return terms.groupBy("feature").agg(F.sum("term").alias("mi"))


def ensemble_scores(importances: DataFrame, methods: int, top: int) -> DataFrame:
    """Half the share of methods that chose a feature plus half its mean importance; the best first, with their rank."""
    by = importances.groupBy("feature").agg((0.5 * F.count("*") / methods + 0.5 * F.avg("importance")).alias("score"))
    return by.orderBy(F.desc(F.round("score", 10)), "feature").limit(top).withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("score", 10)), "feature")))


def forest_importance(df: DataFrame, features: list[str], target: str, trees: int = 20, seed: int = 42) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    v = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip").transform(df.where(F.col(target).isNotNull()))
    fit = RandomForestRegressor(featuresCol="x", labelCol=target, numTrees=trees, maxDepth=4, seed=seed).fit(v)
    return df.sparkSession.createDataFrame([(f, float(w)) for f, w in zip(features, fit.featureImportances.toArray(), strict=True)], "feature string, importance double")


def lasso_importance(df: DataFrame, features: list[str], target: str, alpha: float = 1e-4) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    v = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip").transform(df.where(F.col(target).isNotNull()))
    fit = LinearRegression(featuresCol="x", labelCol=target, regParam=alpha, elasticNetParam=1.0).fit(v)
    return df.sparkSession.createDataFrame([(f, abs(float(w))) for f, w in zip(features, fit.coefficients.toArray(), strict=True)], "feature string, importance double")


def diversify(df: DataFrame, ranked: list[str], most: int, threshold: float = 0.7) -> list[str]:
    """Greedy choice in the ranked order of features that correlate less than the threshold with those chosen.

    Correlations are one aggregation on the executors; only the matrix reaches the driver."""
    if len(ranked) <= most:
        return ranked
    pairs = [(a, b) for i, a in enumerate(ranked) for b in ranked[:i]]
    row = df.agg(*[F.abs(F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))).alias(f"{a}|{b}") for a, b in pairs]).first()
    chosen: list[str] = []
    for f in ranked:
        if len(chosen) < most and all((row[f"{f}|{g}"] or 0) < threshold for g in chosen):
            chosen.append(f)
    return chosen


def pareto_front(trials: DataFrame, more: str, less: str) -> DataFrame:
    """Trials that no other beats in one value without losing in the other: running bests over sorts, not a self join.

    Trials are few (one row per model fit), so the global sort is small."""
    equal = F.min(less).over(W.partitionBy(more))
    best = trials.groupBy(more).agg(F.min(less).alias("__l"))
    best = best.withColumn("__b", F.min("__l").over(W.orderBy(F.desc(more)).rowsBetween(W.unboundedPreceding, -1)))
    rows = trials.withColumn("__e", equal).join(best.select(more, "__b"), more)
    return rows.where((F.col(less) == F.col("__e")) & (F.col("__b").isNull() | (F.col(less) < F.col("__b")))).drop("__e", "__b")

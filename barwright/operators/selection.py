"""Feature selection: usable columns, importances by several methods over purged folds, their table and stability."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .regimes import diversify, ensemble_scores, mutual_information
from .validation import purged_by_rows


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    """Columns of numeric type in their order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in without]


def columns_named(df: DataFrame, part: str, how: str = "in") -> list[str]:
    """Columns whose lower-cased name holds, starts with or ends with ``part`` (how: in, start, end)."""
    fits = {"in": lambda c: part in c, "start": lambda c: c.startswith(part), "end": lambda c: c.endswith(part)}[how]
    return [c for c in df.columns if fits(c.lower())]


def null_ratios(df: DataFrame, columns: list[str], most: float = 0.3) -> DataFrame:
    """(feature, null_ratio, kept) from one pass over all columns."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    long = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("null_ratio")) for c in columns])))
    return long.withColumn("kept", F.coalesce(F.col("null_ratio") < most, F.lit(False)))


def usable_columns(df: DataFrame, columns: list[str], most: float = 0.3) -> list[str]:
    """Those of the columns with a smaller share of nulls than ``most``, in their order."""
    kept = {r.feature for r in null_ratios(df, columns, most).where("kept").collect()}  # one row a column
    return [c for c in columns if c in kept]


def complete_in_window(df: DataFrame, columns: list[str], n: int, order: str = "row_id") -> DataFrame:
    """Adds ``{column}_complete``: whether the last ``n`` rows have no null there."""
    w = W.partitionBy("symbol").orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumns({f"{c}_complete": F.count(F.col(c)).over(w) == F.count("*").over(w) for c in columns})


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, correlation) of all pairs, absolute, over rows where both are known: one aggregation."""
    pairs = [(a, b) for a in features for b in features]
    known = lambda a, b: F.when(F.col(b).isNotNull(), F.col(a).cast("double"))
    corr = lambda a, b: F.abs(F.try_divide(F.covar_pop(a, b), F.stddev_pop(known(a, b)) * F.stddev_pop(known(b, a))))
    row = df.agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    made = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*made)))


def correlation_importance(df: DataFrame, features: list[str], target: str) -> DataFrame:
    row = df.agg(*[F.abs(F.try_divide(F.covar_pop(f, target), F.stddev_pop(F.when(F.col(target).isNotNull(), F.col(f))) * F.stddev_pop(F.when(F.col(f).isNotNull(), F.col(target))))).alias(f) for f in features])
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in features])))


def forest_importance(df: DataFrame, features: list[str], target: str, trees: int = 100, folds: int = 5, overlap: int = 10, seed: int = 42) -> DataFrame:
    """Mean impurity importance of forests fitted on the training rows of purged folds."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = purged_by_rows(df, folds, overlap).where("role = 'train'").where(F.col(target).isNotNull())
    rows = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip").transform(rows).select("fold", "x", target).cache()
    forest = RandomForestRegressor(featuresCol="x", labelCol=target, numTrees=trees, maxDepth=5, seed=seed)
    found = [forest.fit(rows.where(F.col("fold") == k)).featureImportances.toArray() for k in range(folds)]
    rows.unpersist()
    mean = np.mean(found, axis=0)
    return df.sparkSession.createDataFrame([(f, float(w)) for f, w in zip(features, mean, strict=True)], "feature string, importance double")


def _lasso(gram: np.ndarray, cross: np.ndarray, alpha: float, start: np.ndarray) -> np.ndarray:
    """Coordinate descent on the moments of standardised columns; rows are not needed any more."""
    w = start.copy()
    for _ in range(1000):
        moved = 0.0
        for j in range(len(w)):
            rho = cross[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / gram[j, j] if gram[j, j] > 0 else 0.0
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < 1e-12:
            break
    return w


def lasso_path(df: DataFrame, features: list[str], target: str, alphas: int = 20, folds: int = 5, overlap: int = 10) -> tuple[DataFrame, float]:
    """Mean absolute coefficients over purged folds at the alpha with the least test error, and that alpha.

    Moments of every fold's train and test rows come from one aggregation; the fits need them only, so their cost does not
    depend on the number of rows. Columns and the target are scaled by the train rows' deviation."""
    cols = [*features, target]
    rows = purged_by_rows(df, folds, overlap).where(" and ".join(f"{c} is not null" for c in cols))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = [F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]
    products = [F.sum(F.col(cols[i]).cast("double") * F.col(cols[j])).alias(f"p{i}_{j}") for i, j in pairs]
    table = {(r.fold, r.role): r for r in rows.groupBy("fold", "role").agg(F.count("*").alias("n"), *sums, *products).collect()}

    def moments(r):
        mean = np.array([r[f"s{i}"] for i in range(len(cols))]) / r.n
        second = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r.n
        return mean, second

    fits = []
    for k in range(folds):
        if (k, "train") not in table or (k, "test") not in table:
            continue
        mean, second = moments(table[k, "train"])
        cov = second - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 0))
        scale[scale == 0] = 1
        tmean, tsecond = moments(table[k, "test"])
        off = tmean - mean
        test = (tsecond - np.outer(tmean, tmean) + np.outer(off, off)) / np.outer(scale, scale)
        fits.append((cov / np.outer(scale, scale), test))
    top = max((np.abs(c[:-1, -1]).max() for c, _ in fits), default=0.0) or 1e-6
    grid = np.geomspace(top, top * 1e-3, alphas)
    errors, weights = np.zeros(alphas), np.zeros((len(fits), alphas, len(features)))
    for k, (train, test) in enumerate(fits):
        w = np.zeros(len(features))
        for a, alpha in enumerate(grid):
            w = weights[k, a] = _lasso(train[:-1, :-1], train[:-1, -1], alpha, w)
            errors[a] += test[-1, -1] - 2 * w @ test[:-1, -1] + w @ test[:-1, :-1] @ w
    best = int(errors.argmin())
    mean = np.abs(weights[:, best]).mean(0) if fits else np.zeros(len(features))
    out = df.sparkSession.createDataFrame([(f, float(x)) for f, x in zip(features, mean, strict=True)], "feature string, importance double")
    return out, float(grid[best])


METHODS: dict[str, Callable[[DataFrame, list[str], str], DataFrame]] = {
    "rf": forest_importance,
    "mi": mutual_information,
    "lasso": lambda df, features, target: lasso_path(df, features, target)[0],
    "correlation": correlation_importance,
}


def importances(df: DataFrame, features: list[str], target: str, methods: list[str]) -> DataFrame:
    """(method, feature, importance); an unknown method is an error."""
    out = None
    for m in methods:
        if m not in METHODS:
            raise ValueError(f"unknown method {m}; known: {', '.join(METHODS)}")
        found = METHODS[m](df, features, target).toDF("feature", "importance").select(F.lit(m).alias("method"), "feature", "importance")
        out = found if out is None else out.unionByName(found)
    return out


def importance_table(found: DataFrame, methods: list[str]) -> DataFrame:
    """A row per feature: ``{method}_importance``, 0 where a method lacks it, and their mean, the largest first."""
    wide = found.groupBy("feature").pivot("method", methods).agg(F.first("importance")).fillna(0.0, methods)
    wide = wide.withColumnsRenamed({m: f"{m}_importance" for m in methods})
    total = sum((F.col(f"{m}_importance") for m in methods), F.lit(0.0)) / len(methods)
    return wide.withColumn("average_importance", total).orderBy(F.desc("average_importance"), "feature")


def select_features(df: DataFrame, target: str, methods: list[str], features: list[str] | None = None, most: int = 50, threshold: float | None = None) -> DataFrame:
    """(feature, score, rank) of the best features: numeric columns with few nulls, nulls taken as 0, scored by the share of
    methods that chose them and their mean importance. With ``threshold``, correlated ones give way to better ones."""
    features = usable_columns(df, features or numeric_columns(df, (target, "row_id", "n", "fold", "batch_id")))
    filled = df.fillna(0.0, features)
    scores = ensemble_scores(importances(filled, features, target, methods).drop("method"), len(methods), len(features) if threshold else most)
    if threshold is None:
        return scores
    ranked = [r.feature for r in scores.orderBy("rank").collect()]  # one row a feature
    chosen = diversify(filled, ranked, most, threshold)
    order = F.row_number().over(W.orderBy("rank"))
    return scores.where(F.col("feature").isin(chosen)).withColumn("rank", order)


def feature_stability(df: DataFrame, features: list[str], target: str, method: str = "correlation", subsets: int = 5, share: float = 0.8) -> DataFrame:
    """Mean, deviation, coefficient of variation and extremes of a method's importance over hashed subsets of the rows."""
    out = None
    for k in range(subsets):
        part = df.where(F.pmod(F.col("row_id") * 48271 + k * 69621 + F.col("row_id") * k * 16807, F.lit(10007)) < int(10007 * share))
        found = METHODS[method](part, features, target)
        out = found if out is None else out.union(found)
    by = out.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"), F.min("importance").alias("min"), F.max("importance").alias("max"))
    return by.withColumn("cv", F.try_divide("std", "mean"))

"""Shapley values of forecasts: exact path attribution for tree ensembles, closed forms for lines, and what is made of them.

A leaf's value is a product game: it pays v times, per feature of its path, 1 or 0 (whether the row fits the path's
interval) where the feature is known, and the share z of training rows that go that way where it is not. The Shapley value
of such a game is an integral over one variable of a polynomial whose degree is under the path's number of features, so a
few Gauss-Legendre points give it exactly. Leaves add up, so do trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import shared_path
from .validation import purged_by_rows


@dataclass(frozen=True)
class Leaves:
    """A row a leaf: its weighted value, and for each feature of its path (padded) the feature, the interval (low, high]
    and the share of rows that stay."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    @property
    def base(self) -> float:
        """The expectation over the training rows."""
        return float((self.value * self.share.prod(1)).sum())

    def part(self, at: slice) -> Leaves:
        return Leaves(self.value[at], self.feature[at], self.low[at], self.high[at], self.share[at])

    def values(self, x: np.ndarray, features: int) -> np.ndarray:
        """Shapley values of each row of x, a column a feature."""
        depth = self.feature.shape[1]
        points, weights = np.polynomial.legendre.leggauss(depth // 2 + 1)
        points, weights = (points + 1) / 2, weights / 2
        fits = []
        for d in range(depth):
            v = x[:, np.maximum(self.feature[:, d], 0)]
            fits.append((~(v <= self.low[:, d]) & ((v <= self.high[:, d]) | (self.high[:, d] == np.inf)) | (self.feature[:, d] < 0)).astype(np.float64))
        sums = [np.zeros((len(x), len(self.value))) for _ in range(depth)]
        for t, w in zip(points, weights, strict=True):
            factors = [self.share[:, d] * (1 - t) + fits[d] * t for d in range(depth)]  # over 0, since no share is 0
            product = np.prod(factors, axis=0) * w
            for d in range(depth):
                sums[d] += product / factors[d]
        out = np.zeros((len(x), features))
        for d in range(depth):
            part = self.value * (fits[d] - self.share[:, d]) * sums[d]
            real = np.flatnonzero(self.feature[:, d] >= 0)
            onto = np.zeros((len(real), features))
            onto[np.arange(len(real)), self.feature[real, d]] = 1
            out += part[:, real] @ onto
        return out


def leaves_of(model) -> Leaves:
    """The leaves of an MLlib forest or boosted ensemble of regression trees, from its saved nodes. They grow with the number
    and depth of trees, not with rows. Splits by category are an error."""
    spark = SparkSession.active()
    path = shared_path(spark, "model")
    model.write().save(path)
    n = F.col("nodeData")
    cover = n["impurityStats"][0]
    nodes = spark.read.parquet(f"{path}/data").select("treeID", n["id"].alias("id"), n["prediction"].alias("value"), cover.alias("cover"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"), n["split"]["leftCategoriesOrThreshold"].alias("cut"), n["split"]["numCategories"].alias("kinds"))
    by = {(r.treeID, r.id): r for r in nodes.collect()}
    if any(r.left >= 0 and r.kinds >= 0 for r in by.values()):
        raise ValueError("splits by category have no intervals")
    trees = sorted({t for t, _ in by})
    scale = [1 / len(trees)] * len(trees) if "Forest" in type(model).__name__ else list(model.treeWeights)
    found: list[tuple[float, dict]] = []

    def walk(tree: int, node: int, path: dict) -> None:
        r = by[tree, node]
        if r.left < 0:
            found.append((r.value * scale[tree], path))
            return
        low, high, share = path.get(r.feature, (-np.inf, np.inf, 1.0))
        cut = r.cut[0]
        walk(tree, r.left, path | {r.feature: (low, min(high, cut), share * by[tree, r.left].cover / r.cover)})
        walk(tree, r.right, path | {r.feature: (max(low, cut), high, share * by[tree, r.right].cover / r.cover)})

    for t in trees:
        walk(t, 0, {})
    depth = max(1, max(len(p) for _, p in found))
    shape = (len(found), depth)
    out = Leaves(np.array([v for v, _ in found]), np.full(shape, -1), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape))
    for i, (_, path) in enumerate(found):
        for d, (f, (low, high, share)) in enumerate(sorted(path.items())):
            out.feature[i, d], out.low[i, d], out.high[i, d], out.share[i, d] = f, low, high, share
    return out


#: Leaves that are sent to the executors at once.
_LEAVES = 1 << 18


def _summed(sent, features: int, block: int):
    """What adds the values of all leaves that were sent, for batches of vectors."""

    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parts = [sent.value.part(slice(k, k + 4096)) for k in range(0, len(sent.value.value), 4096)]
        for xs in batches:
            out = [np.zeros((0, features))]
            for i in range(0, len(xs), block):
                x = np.stack(xs.iloc[i : i + block])
                out.append(sum(p.values(x, features) for p in parts))
            yield pd.Series(list(np.concatenate(out)))

    return values


def tree_attributions(rows: DataFrame, model, features: list[str], vector: str = "__x", block: int = 128) -> DataFrame:
    """Adds ``shap_{feature}`` and ``base``: together they are the model's forecast. Rows are worked off in blocks, large
    models in parts of fixed size that are sent one after another. A NaN goes to the right of each split, as in the model."""
    leaves = leaves_of(model)
    total = None
    for at in range(0, len(leaves.value), _LEAVES):
        sent = rows.sparkSession.sparkContext.broadcast(leaves.part(slice(at, at + _LEAVES)))
        part = F.pandas_udf(_summed(sent, len(features), block), "array<double>")(vector_to_array(vector))
        total = part if total is None else F.zip_with(total, part, lambda a, b: a + b)
    rows = rows.withColumn("__shap", total)
    return rows.withColumns({f"shap_{f}": F.col("__shap")[i] for i, f in enumerate(features)} | {"base": F.lit(leaves.base)}).drop("__shap")


def linear_attributions(df: DataFrame, features: list[str], target: str, train: DataFrame | None = None) -> DataFrame:
    """Adds ``shap_{feature}``, the slope times the distance from the mean, and ``base``, the mean of the target, for a least
    squares fit on the complete rows of ``train`` (or of df). Moments come from one aggregation; features that are constant
    or that others give exactly share by the pseudo-inverse."""
    known = (df if train is None else train).where(" and ".join(f"`{c}` is not null" for c in [*features, target]))
    cols = [F.col(f"`{c}`").cast("double") for c in [*features, target]]
    n = len(cols)
    row = known.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(n)])
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    scale = np.sqrt(np.diag(cov)[:-1])
    scale[scale == 0] = 1
    slope = np.linalg.pinv(cov[:-1, :-1] / np.outer(scale, scale), rcond=1e-12) @ (cov[:-1, -1] / scale) / scale
    made = {f"shap_{f}": F.lit(float(b)) * (F.col(f"`{f}`") - F.lit(float(m))) for f, b, m in zip(features, slope, mean, strict=False)}
    return df.withColumns(made | {"base": F.lit(float(mean[-1]))})


def stratified(df: DataFrame, target: str, n: int = 100, groups: int = 5, seed: int = 42) -> DataFrame:
    """Up to n / groups rows of each quantile group of the target, in the order of a hash; equal quantiles make one group."""
    cuts = df.agg(F.percentile(target, F.array(*[F.lit(i / groups) for i in range(1, groups)])).alias("q")).first().q or []
    group = sum(((F.col(target) > q).cast("int") for q in sorted(set(cuts))), F.lit(0))
    order = W.partitionBy("__group").orderBy(F.xxhash64(F.lit(seed), "symbol", "row_id"))
    return df.where(F.col(target).isNotNull()).withColumn("__group", group).withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= n // groups).drop("__group", "__nth")


def mean_absolute(values: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """(by, feature, importance): mean absolute attributions."""
    wide = values.groupBy(*by).agg(*[F.avg(F.abs(f"`shap_{f}`")).alias(f) for f in features])
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("importance")) for f in features])))


def _fitted(rows: DataFrame, features: list[str], target: str, method: str, trees: int, seed: int):
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    same = {"featuresCol": "__x", "labelCol": target, "seed": seed}
    if method == "rf":
        return RandomForestRegressor(numTrees=trees, **same).fit(rows)
    if method == "gbm":
        return GBTRegressor(maxIter=trees, maxDepth=3, **same).fit(rows)
    raise ValueError(f"unknown method {method}; known: rf, gbm")


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(df.withColumns({f: F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features}))


def shap_values(df: DataFrame, features: list[str], target: str, method: str = "rf", n: int = 100, trees: int = 100, seed: int = 42) -> DataFrame:
    """Attributions of a model (rf or gbm) that is fitted on a stratified sample of n rows, for the sample's rows; null
    features are 0, rows without a target are left out."""
    rows = _vectors(stratified(df, target, n, seed=seed), features)
    return tree_attributions(rows, _fitted(rows, features, target, method, trees, seed), features).drop("__x")


def shap_importance(df: DataFrame, features: list[str], target: str, method: str = "rf", n: int = 100, trees: int = 100, seed: int = 42) -> DataFrame:
    """(feature, importance) by mean absolute attributions, adding up to one; all 0 where the model is constant."""
    found = mean_absolute(shap_values(df, features, target, method, n, trees, seed), features, [])
    total = F.sum("importance").over(W.partitionBy(F.lit(0)))  # a row a feature
    return found.withColumn("importance", F.coalesce(F.try_divide("importance", total), F.lit(0.0)))


def attribution_stability(by_fold: DataFrame) -> DataFrame:
    """(feature, stability) from (fold, feature, importance): one less the coefficient of variation over folds, within 0
    and 1; 0 for a feature without any weight; no rows where there is one fold only."""
    by = by_fold.groupBy("feature").agg(F.avg("importance").alias("m"), F.stddev_pop("importance").alias("s"), F.count("importance").alias("folds"))
    stability = F.when(F.col("m") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("s") / F.col("m")))).otherwise(0.0)
    return by.where("folds > 1").select("feature", stability.alias("stability"))


def shap_by_fold(df: DataFrame, features: list[str], target: str, method: str = "rf", folds: int = 5, overlap: int = 10, trees: int = 20, seed: int = 42) -> DataFrame:
    """(fold, feature, importance): a model fitted on each purged fold's training rows, attributed on its test rows; method
    is rf, gbm or linear."""
    parts = purged_by_rows(df, folds, overlap).where(F.col(target).isNotNull())
    parts = parts if method == "linear" else _vectors(parts, features)
    out = None
    for k in range(folds):
        here = parts.where(F.col("fold") == k)
        train, test = here.where("role = 'train'"), here.where("role = 'test'")
        values = linear_attributions(test, features, target, train) if method == "linear" else tree_attributions(test, _fitted(train, features, target, method, trees, seed), features)
        found = mean_absolute(values, features, ["fold"])
        out = found if out is None else out.unionByName(found)
    return out

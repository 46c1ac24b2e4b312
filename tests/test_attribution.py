"""Attributions against all coalitions, and what is made of them."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from barwright.operators import attribution as at

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        a, b, c, d = (rng.gauss(0, 1) for _ in range(4))
        rows.append(("S", i, i, a, b, c, float(round(d)), 2 * a + b * b - a * c + 0.1 * rng.gauss(0, 1)))
    return VectorAssembler(inputCols=NAMES, outputCol="__x").transform(spark.createDataFrame(rows, "symbol string, row_id long, ts long, a double, b double, c double, d double, y double"))


def conditional(model, x, known):
    """The ensemble's expectation with only the known features, down every tree by the training rows' shares."""

    def down(node):
        if node.numDescendants() == 0:
            return node.prediction()
        split, left, right = node.split(), node.leftChild(), node.rightChild()
        if split.featureIndex() in known:
            return down(left if x[split.featureIndex()] <= split.threshold() else right)
        n = [k.impurityStats().count() for k in (left, right)]
        return (n[0] * down(left) + n[1] * down(right)) / sum(n)

    weights = [1 / model.getNumTrees] * model.getNumTrees if "Forest" in type(model).__name__ else model.treeWeights
    return sum(w * down(t._java_obj.rootNode()) for w, t in zip(weights, model.trees, strict=True))


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_tree_values_equal_all_coalitions(frame, kind):
    same = {"featuresCol": "__x", "labelCol": "y", "seed": 3}
    model = (RandomForestRegressor(numTrees=3, maxDepth=4, **same) if kind == "forest" else GBTRegressor(maxIter=3, maxDepth=3, **same)).fit(frame)
    got = at.tree_attributions(model.transform(frame), model, NAMES, block=50).orderBy("row_id").collect()
    for r in got:
        assert r.base + sum(r[f"shap_{f}"] for f in NAMES) == pytest.approx(r.prediction, abs=1e-9)
    for r in got[:3]:
        x = [r[f] for f in NAMES]
        told = {k: conditional(model, x, set(k)) for n in range(5) for k in itertools.combinations(range(4), n)}
        assert r.base == pytest.approx(told[()], abs=1e-9)
        for i, f in enumerate(NAMES):
            rest = [j for j in range(4) if j != i]
            value = sum(math.factorial(n) * math.factorial(3 - n) / 24 * (told[tuple(sorted((*k, i)))] - told[k]) for n in range(4) for k in itertools.combinations(rest, n))
            assert r[f"shap_{f}"] == pytest.approx(value, abs=1e-9)


def test_large_models_are_sent_in_parts(frame, monkeypatch):
    model = RandomForestRegressor(featuresCol="__x", labelCol="y", numTrees=4, maxDepth=4, seed=1).fit(frame)
    whole = at.tree_attributions(frame, model, NAMES).orderBy("row_id").toPandas()
    monkeypatch.setattr(at, "_LEAVES", 20)
    parts = at.tree_attributions(frame, model, NAMES).orderBy("row_id").toPandas()
    for f in NAMES:
        assert parts[f"shap_{f}"].values == pytest.approx(whole[f"shap_{f}"].values, abs=1e-10)


def test_linear_values_and_odd_columns(spark, frame):
    got = at.linear_attributions(frame.withColumns({"same": F.lit(3.0), "twice": 2 * F.col("a")}), ["a", "b", "same", "twice"], "y").toPandas()
    x, y = got[["a", "b"]].to_numpy(), got.y.to_numpy()
    slope = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    assert got.shap_b.to_numpy() == pytest.approx((x[:, 1] - x[:, 1].mean()) * slope[1], abs=1e-8) and (got.shap_same == 0).all()
    assert (got.shap_a + got.shap_twice).to_numpy() == pytest.approx((x[:, 0] - x[:, 0].mean()) * slope[0], abs=1e-8)
    none = spark.createDataFrame([], frame.drop("__x").schema)
    assert at.linear_attributions(none, NAMES, "y").count() == 0


def test_sample_importance_and_stability(spark, frame):
    rows = frame.drop("__x")
    sample = at.stratified(rows, "y", 50)
    cuts = np.quantile(rows.toPandas().y, [0.2, 0.4, 0.6, 0.8])
    assert np.bincount(np.searchsorted(cuts, sample.toPandas().y)).tolist() == [10] * 5
    assert sorted(sample.toPandas().row_id) == sorted(at.stratified(rows.repartition(7), "y", 50).toPandas().row_id)
    assert at.stratified(rows.withColumn("y", F.lit(1.0)), "y", 50).count() == 10
    got = {r.feature: r.importance for r in at.shap_importance(rows, NAMES, "y", "gbm", 200, 10).collect()}
    assert sum(got.values()) == pytest.approx(1) and max(got, key=got.get) == "a" and got["a"] > 3 * got["d"]
    told = spark.createDataFrame([(0, "p", 1.0), (1, "p", 1.0), (0, "q", 1.0), (1, "q", 3.0), (0, "r", 0.0), (1, "r", 0.0), (0, "s", 2.0)], "fold int, feature string, importance double")
    assert {r.feature: r.stability for r in at.attribution_stability(told).collect()} == {"p": 1.0, "q": 0.5, "r": 0.0}
    by = at.shap_by_fold(rows, NAMES, "y", "gbm", folds=2, trees=3)
    assert by.count() == 8 and at.attribution_stability(by).where("stability between 0 and 1").count() == 4
    with pytest.raises(ValueError):
        at.shap_importance(rows, NAMES, "y", "svm")

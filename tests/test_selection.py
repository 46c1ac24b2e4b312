import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.operators import loss, metrics, selection, tuner, tuning, validation
from barwright.sources.samples import samples


def test_lasso_path_matches_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = 2 * x[:, 0] - x[:, 2] + 0.1 * rng.normal(size=600)
    frame = pd.DataFrame(x, columns=list("abcd")).assign(y=y, row_id=range(600), symbol="S", ts=pd.Timestamp("2024-01-01"))
    found, alpha = selection.lasso_path(spark.createDataFrame(frame), list("abcd"), "y")
    w = found.toPandas().set_index("feature").importance
    assert w["a"] / w["c"] == pytest.approx(2, abs=0.1) and w["a"] == pytest.approx(2 / y.std(), abs=0.05) and w["b"] < 0.05 and w["d"] < 0.05 and alpha > 0


def test_unknown_methods_and_names(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "row_id long, a_importance double, other string")
    with pytest.raises(ValueError, match="unknown method"):
        selection.importances(df, ["a_importance"], "row_id", ["nothing"])
    assert selection.columns_named(df, "_importance", "end") == ["a_importance"] and selection.numeric_columns(df, ("row_id",)) == ["a_importance"]


def test_overfit_is_per_symbol(spark):
    rows = [("A", i, float(i)) for i in range(8)] + [("B", i, float((i * 5) % 8)) for i in range(8)]
    both = validation.backtest_overfit(spark.createDataFrame(rows, "symbol string, combo int, rmse double")).toPandas()
    one = validation.backtest_overfit(spark.createDataFrame(rows[:8], "symbol string, combo int, rmse double")).toPandas()
    assert sorted(both.symbol) == ["A", "B"] and both.set_index("symbol").pbo["A"] == one.pbo[0]


def test_parameter_stability_edges(spark):
    make = lambda sets: spark.createDataFrame([(s,) for s in sets], "params map<string,double>")
    of = lambda sets: metrics.parameter_stability(make(sets)).first()[0]
    assert of([{"a": 1.0}]) == 1 and of([{"a": 2.0}, {"a": 2.0}]) == 1 and of([{"a": 1.0, "b": 9.0}, {"a": 3.0}]) == pytest.approx(0.5)


def test_attention_weights(spark):
    layers = [(np.eye(2), np.zeros(2), np.ones(2), np.zeros(2)), (np.array([[1.0], [0.5]]), np.zeros(1))]
    rows = spark.createDataFrame([(1, [[1.0, 2.0], [2.0, 1.0], [3.0]]), (2, None)], "row_id long, history array<array<double>>")
    got = {r.row_id: r.weights for r in loss.attention_weights(rows, "history", layers).collect()}
    assert got[2] is None and sum(got[1]) == pytest.approx(1) and got[1][1] > got[1][0]
    with pytest.raises(Exception, match="more features"):
        loss.attention_weights(spark.createDataFrame([(1, [[1.0, 2.0, 3.0]])], rows.schema), "history", layers).collect()


def test_tuner(spark, sf):
    df = samples(spark, sf)
    c = tuner.TunerConfig(model="linear", trials=2, folds=2)
    trials = tuner.search(df.where("row_id < 700"), ["yhat", "vol", "mom"], "y", c).cache()
    assert trials.count() == 2 and tuner.best_params(trials).keys() == {"penalty", "mix"}
    again = tuner.search(df.where("row_id < 700"), ["yhat", "vol", "mom"], "y", c, first=1)
    assert [dict(r.params) for r in again.orderBy("trial_id").collect()][0] == [dict(r.params) for r in trials.orderBy("trial_id").collect()][1]
    predict = tuner.fit_final(df.where("row_id < 700"), ["yhat", "vol", "mom"], "y", trials, c)
    scored = tuner.evaluate(predict, df.where("row_id >= 700"), "y", ["symbol"]).first()
    assert scored.rmse > 0 and scored.annual_volatility is not None
    by = tuner.search_by_regime(df, ["vol", "mom"], "y", "regime", tuner.TunerConfig(model="linear", trials=1, folds=2), 150)
    assert by.select("study").distinct().count() >= 2
    with pytest.raises(ValueError, match="unknown model"):
        tuner.estimator("nothing", {}, "x", "y", 1)
    assert tuning.REPAIRS["child_weight"]({"child_weight": 0.1, "subsample": 0.5})["child_weight"] > 1
    assert df.where(F.col("row_id") < 0).count() == 0


def test_overfit_needs_four_configurations(spark):
    rows = [("A", c, float(c)) for c in range(3)] + [("B", c, float(c)) for c in range(4)]
    got = {r.symbol: r.pbo for r in validation.backtest_overfit(spark.createDataFrame(rows, "symbol string, combo int, rmse double")).collect()}
    assert got["A"] is None and got["B"] is not None


def test_parameter_stability_without_a_common_parameter(spark):
    of = lambda sets: metrics.parameter_stability(spark.createDataFrame([(s,) for s in sets], "params map<string,double>")).first()[0]
    assert of([{"a": 1.0}, {"b": 2.0}]) == 0 and of([{"a": 0.0}, {"a": 0.0}]) == 0 and of([{"a": 1.0}, {"a": 1.0}]) == 1

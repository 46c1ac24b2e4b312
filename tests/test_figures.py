import pytest

from barwright.operators import figures

SHAPE = "symbol string, row_id long, y double, yhat double, regime int"


def test_decay_of_short_and_odd_series(spark):
    # Errors grow by one in every part of A; B has one row; C has no forecast.
    rows = [("A", i, float(1 + max(1, -(-i * 5 // 9))), 1.0, 1) for i in range(10)] + [("B", 0, 2.0, 1.0, 2), ("C", 0, 2.0, None, 2), (None, 0, 3.0, 1.0, None)]
    out = figures.decay_figure(spark.createDataFrame(rows, SHAPE), ["rmse", "mae"]).collect()
    a = sorted((r for r in out if r.symbol == "A" and r.metric == "mae"), key=lambda r: r.part)
    assert [r.value for r in a] == pytest.approx([1, 2, 3, 4, 5]) and [r.trend for r in a] == pytest.approx([1, 2, 3, 4, 5])
    assert a[0].slope == pytest.approx(1) and a[0].p_value == 0
    assert [(r.part, r.value, r.trend) for r in out if r.symbol == "B" and r.metric == "rmse"] == [(1, 1.0, None)]
    assert not [r for r in out if r.symbol == "C"] and [r.value for r in out if r.symbol is None] == [2.0, 2.0]


def test_regime_names(spark):
    rows = [("A", i, 2.0, 1.0, g) for i, g in enumerate([0, 1, 7, None])]
    out = figures.regime_figure(spark.createDataFrame(rows, SHAPE), ["mae"]).collect()
    assert {(r.regime, r.regime_name) for r in out} == {(0, "Normal"), (1, "Bullish Volatile"), (7, "Regime 7"), (None, None)}
    assert all(r.value == 1 for r in out)


def test_importance_ties_and_unknown(spark):
    rows = [("b", 0.5), ("a", 0.5), ("c", 0.1), ("c", 0.3), ("d", None)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    out = figures.importance_figure(df, 3).orderBy("rank").collect()
    assert [(r.rank, r.feature) for r in out] == [(1, "a"), (2, "b"), (3, "c")] and out[2].std == pytest.approx(0.1)
    assert [r.feature for r in figures.importance_figure(df).orderBy("rank").collect()] == ["a", "b", "c", "d"]
    assert figures.importance_figure(df.limit(0)).count() == 0

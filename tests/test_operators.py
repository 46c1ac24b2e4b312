import numpy as np
import pandas as pd
import pytest

from barwright.operators import blocks, loss, recursive, regimes, validation, volatility
from barwright.sources.bars import OhlcvColumns, canonical


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
    pdf = pd.DataFrame({"date": pd.date_range("2020-01-01", periods=300).astype("datetime64[us]"), "Open": close * 0.99, "High": close * 1.02, "Low": close * 0.97, "Close": close, "Volume": rng.integers(1, 90, 300).astype(float)})
    return canonical(spark.createDataFrame(pdf), OhlcvColumns())


def test_returns_do_not_depend_on_scale(bars):
    from pyspark.sql import functions as F

    a = volatility.returns(bars).orderBy("ts").toPandas()["returns"]
    b = volatility.returns(bars.withColumn("close", F.col("close") * 7)).orderBy("ts").toPandas()["returns"]
    assert np.allclose(a[1:], b[1:])


def test_rolling_volatility_matches_pandas(bars):
    out = volatility.rolling_volatility(volatility.returns(bars)).orderBy("ts").toPandas()
    r = np.log(out.close / out.close.shift()).fillna(0)
    assert np.allclose(out.rolling_vol_20, r.rolling(20, min_periods=1).std(ddof=0))


def test_ema_matches_pandas(bars):
    out = blocks.moving_averages(bars).orderBy("ts").toPandas()
    assert np.allclose(out.ema_fast, out.close.ewm(span=12, adjust=False).mean())


def test_entropy_lies_within_bounds(bars):
    out = volatility.permutation_entropy(bars).toPandas()["perm_entropy"].dropna()
    assert len(out) == 200 and out.between(0, 1).all()


def test_folds_leak_nothing(spark):
    days = pd.date_range("2021-01-01", periods=100).astype("datetime64[us]")
    rows = spark.createDataFrame(pd.DataFrame({"symbol": "A", "row_id": range(100), "ts": days, "y": 0.1, "yhat": 0.2, "vol": 0.1}))
    out = validation.purged_by_days(rows).toPandas()
    for _, fold in out.groupby("fold"):
        test, train = fold[fold.role == "test"], fold[fold.role == "train"]
        assert not set(test.row_id) & set(train.row_id)
        lo, hi = test.ts.min() - pd.Timedelta(days=5), test.ts.max() + pd.Timedelta(days=5)
        assert not train.ts.between(lo, hi).any()


def test_transition_rows_sum_to_one(spark):
    rows = spark.createDataFrame([("A", i, s) for i, s in enumerate([1, 1, 2, 1, 3])], "symbol string, row_id long, s int")
    out = regimes.transition_matrix(rows, "s").toPandas()
    assert np.allclose(out.groupby("from_state").prob.sum(), 1)
    assert np.allclose(out[out.from_state == 3].prob, 1 / 3)


def test_asymmetry_weights_stay_within_bounds(spark):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, -1.0), (1, -2.0), (1, 3.0), (2, 1.0)], "b int, r double")
    out = rows.withColumn("w", loss.asymmetry(F.col("r"), 0.5, W.partitionBy("b"))).toPandas()
    assert out.w.between(0.1, 10).all()
    assert loss.LossConfig.from_config(loss.LossConfig(k=2.0).get_config()).k == 2.0


def test_more_holidays_with_days_around(spark):
    import datetime as dt

    from barwright.operators.assembly import calendar_features

    days = [dt.date(2024, 3, 4) + dt.timedelta(i) for i in range(5)]
    df = spark.createDataFrame([("A", d, 1.0) for d in days], "symbol string, ts date, volume double")
    given = spark.createDataFrame([(days[2],), (days[2],), (days[3],), (None,)], "day date")
    out = calendar_features(df, more_holidays=given).orderBy("ts").toPandas()
    assert out.is_holiday.tolist() == [0, 0, 1, 1, 0]
    assert out.is_day_before_holiday.tolist() == [0, 1, 1, 0, 0]
    assert out.is_day_after_holiday.tolist() == [0, 0, 0, 1, 1]
    none = calendar_features(df, more_holidays=given.limit(0)).toPandas()
    assert none.is_holiday.sum() == 0 and len(none) == 5


def test_features_with_models(spark):
    import numpy as np
    import pandas as pd

    from barwright.operators.assembly import volatility_features

    close = 100 + np.cumsum(np.random.default_rng(1).normal(0, 1, 60))
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=60), "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": 1.0}))
    plain, whole = volatility_features(df).columns, volatility_features(df, models=True)
    assert set(whole.columns) - set(plain) == {"garch_vol", "garch_alpha", "garch_beta", "garch_forecast", "egarch_vol", "vol_asymmetry", "vol_of_vol"}
    assert whole.count() == 60

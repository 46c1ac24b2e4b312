import pandas as pd
from pyspark.sql import functions as F

from barwright.streaming.bars import stream_bars, stream_quantile


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def source(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=240, freq="7min").astype("datetime64[us]"), "symbol": ["A", "B"] * 120, "value": [float(i % 37) for i in range(240)]})
    rows.to_parquet(tmp_path / "events.parquet")
    return rows, spark.readStream.schema("ts timestamp, symbol string, value double").parquet(str(tmp_path))


def test_stream_bars_equal_batch(spark, tmp_path):
    rows, stream = source(spark, tmp_path)
    drain(stream_bars(stream), "bars", "complete")
    got = spark.table("bars").toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    want = rows.assign(ts=rows.ts.dt.floor("h")).groupby(["symbol", "ts"]).value.agg(["first", "max", "min", "last"]).reset_index()
    assert (got[["open", "high", "low", "close"]].values == want[["first", "max", "min", "last"]].values).all()


def test_stream_quantile_keeps_last_values(spark, tmp_path):
    rows, stream = source(spark, tmp_path)
    drain(stream_quantile(stream, 0.5, 50), "quantiles", "append")
    got = spark.table("quantiles").where(F.col("symbol") == "A").toPandas()
    last = sorted(rows[rows.symbol == "A"].value.tail(50))
    assert got["quantile"].iloc[0] == last[int(0.5 * 49)] and got.n.iloc[0] == 50

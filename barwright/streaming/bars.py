"""Bars and stateful quantiles over streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of (ts, symbol, value) per window; events later than ``late`` are dropped by the watermark."""
    price = F.col("value")
    bars = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "symbol").agg(F.min_by(price, "ts").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "ts").alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_quantile(events: DataFrame, q: float = 0.95, n: int = 1000) -> DataFrame:
    """The q quantile (lower order statistic) of each symbol's last n values, a row per symbol and batch; the state is
    that buffer and no more."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values = list(state.get[0]) if state.exists else []
        new = pd.concat(list(batches)).sort_values("ts")["value"].tolist()
        values = (values + new)[-n:]
        state.update((values,))
        yield pd.DataFrame({"symbol": [key[0]], "quantile": [sorted(values)[int(q * (len(values) - 1))]], "n": [len(values)]})

    return events.select("symbol", "ts", "value").groupBy("symbol").applyInPandasWithState(update, "symbol string, quantile double, n long", "values array<double>", "append", GroupStateTimeout.NoTimeout)

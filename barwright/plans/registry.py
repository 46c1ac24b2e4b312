"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assembly, context, indicators, models, momentum, search, validation, volatility

_PARTS = (volatility, indicators, context, validation, models, assembly, search, momentum)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PARTS for k, f in p.Q.items()}
SQL: dict[str, str] = {k: s for p in _PARTS for k, s in p.SQL.items()}

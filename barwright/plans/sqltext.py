"""SQL text of the bar tables and frames, for the registered queries' SQL."""

from __future__ import annotations

from ..operators import unitroot

ORDER_BARS = "b0 AS (SELECT 'ORD' AS symbol, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY o_orderdate)"
EVENT_BARS = "b0 AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"
_KEY = "{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey}"
SHIP_BARS = f"s0 AS (SELECT l_shipdate AS ts, arg_max(l_extendedprice, {_KEY}) AS close FROM lineitem GROUP BY l_shipdate)"


def last(n: int, skip: int = 0) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"


SO_FAR = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SERIES = "OVER (PARTITION BY symbol ORDER BY ts)"
WHOLE = "OVER (PARTITION BY symbol)"


def roll(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {last(n)} = {n} THEN {agg} {last(n)} END"


def sma(x: str, n: int) -> str:
    return roll(f"avg({x})", x, n)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {SERIES}"


def bars_sql(bars: str, stages: list[dict[str, str]], out: dict[str, str], digits: int = 6, more: str = "") -> str:
    """Stages add columns to the bars one after another; out has the result's expressions, doubles rounded."""
    text, at = [bars] + ([more] if more else []), "b0"
    for i, stage in enumerate(stages, 1):
        text.append(f"b{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {at})")
        at = f"b{i}"
    cols = [f"CAST({e[1:]} AS INTEGER) AS {n}" if e.startswith("#") else f"{e[1:]} AS {n}" if e.startswith("=") else f"round(CASE WHEN isnan(({e})::DOUBLE) THEN NULL ELSE {e} END, {digits}) AS {n}" for n, e in out.items()]
    return f"WITH {', '.join(text)} SELECT symbol, ts, {', '.join(cols)} FROM {at}"


def powers(factors: tuple[float, ...], x: str) -> str:
    return " + ".join(f"({f!r}) * power({x}, {i})" for i, f in enumerate(factors))


def adf_p_sql(stat: str) -> str:
    """p of a Dickey-Fuller statistic with a constant, from the same published values as the operator's."""
    z = f"(CASE WHEN {stat} <= {unitroot.TURN} THEN {powers(unitroot.BELOW, stat)} ELSE {powers(unitroot.ABOVE, stat)} END)"
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = f"(0.3989422804014327 * exp(-power({z}, 2) / 2) * {t} * ({powers(unitroot.NORMAL, t)}))"
    return f"CASE WHEN {stat} > {unitroot.MOST} THEN 1 WHEN {stat} < {unitroot.LEAST} THEN 0 WHEN {z} < 0 THEN {tail} ELSE 1 - {tail} END"

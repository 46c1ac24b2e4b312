"""Queries of metrics, folds and validation over prediction samples."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import validation as v
from ..sources.samples import samples
from .sqltext import ORDER_BARS, lag, last, roll

Q, SQL = {}, {}

SAMPLES = f"""{ORDER_BARS}, s1 AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS y0 FROM b0),
s2 AS (SELECT symbol, ts, volume, round(y0, 10) AS y, round(avg(y0) {last(5, 1)}, 10) AS yhat, round({roll('stddev_pop(y0)', 'y0', 20)}, 10) AS vol, round({roll('avg(y0)', 'y0', 20)}, 10) AS mom FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS row_id, round(quantile_cont(vol, 0.7) OVER (PARTITION BY symbol), 10) AS hv FROM s2 WHERE vol IS NOT NULL),
s AS (SELECT symbol, row_id, ts, y, yhat, vol, mom, volume, (row_id // 64)::BIGINT AS batch_id, CASE WHEN vol > hv AND mom > 0 THEN 1 WHEN vol > hv THEN 2 WHEN mom > 0 THEN 3 ELSE 4 END AS regime, count(*) OVER (PARTITION BY symbol) AS n FROM s3)"""


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and NaN as null; whole numbers as long."""
    kinds = {"double": lambda c: F.round(F.when(~F.isnan(c), F.col(c)), digits).alias(c), "int": lambda c: F.col(c).cast("long"), "bigint": lambda c: F.col(c)}
    return df.select(*[kinds.get(k, F.col)(c) for c, k in df.dtypes])


def add(name: str, make, sql: str | None, digits: int = 6, ctes: str = "", cols: dict[str, str] | None = None) -> None:
    Q[name] = lambda spark, sf: tidy(make(samples(spark, sf)), digits)
    if sql:
        SQL[name] = f"WITH {SAMPLES}{ctes} {sql}"


r6 = lambda e, n: f"round({e}, 6) AS {n}"
add("samples", lambda d: d, f"SELECT symbol, row_id, ts, {r6('y', 'y')}, {r6('yhat', 'yhat')}, {r6('vol', 'vol')}, {r6('mom', 'mom')}, {r6('volume', 'volume')}, batch_id, regime::BIGINT AS regime FROM s")


def risk_sql(by: str, r: str, src: str) -> tuple[str, str]:
    p = f"PARTITION BY {by}"
    ctes = f""", g1 AS (SELECT *, {r} AS r FROM {src}), g2 AS (SELECT *, product(1 + r) OVER ({p} ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g, row_number() OVER ({p} ORDER BY r, row_id) AS k, ceil(count(r) OVER ({p}) * 5 / 100.0) AS cut FROM g1),
g3 AS (SELECT *, g / greatest(max(g) OVER ({p} ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) - 1 AS dd FROM g2),
g4 AS (SELECT {by}, count(r) AS n, avg(r) AS m, stddev_samp(r) AS sd, avg(power(least(r, 0), 2)) AS down, least(min(dd), 0) AS mdd, product(1 + r) AS total, avg(r) FILTER (k <= cut) AS cvar, sum(r) AS sr, sum(-least(r, 0)) AS pain FROM g3 GROUP BY {by})"""
    out = f"SELECT {by}{'::BIGINT AS regime' if by == 'regime' else ''}, {r6('m / nullif(sd, 0) * sqrt(252)', 'sharpe')}, {r6('m * 252 / nullif(sqrt(down) * sqrt(252), 0)', 'sortino')}, {r6('sd * sqrt(252)', 'annual_volatility')}, {r6('mdd', 'max_drawdown')}, round(CASE WHEN round(mdd, 12) < 0 THEN (power(total, 252 / n) - 1) / abs(mdd) END, 6) AS calmar, {r6('cvar', 'cvar')}, {r6('sr / nullif(pain, 0)', 'gain_to_pain')} FROM g4"
    return ctes, out


STRAT = ", st AS (SELECT *, coalesce(sign(yhat), 0) * y AS strat, coalesce(sign(yhat), 0) * y - coalesce(abs(yhat - coalesce(lag(yhat) OVER (PARTITION BY symbol ORDER BY row_id), 0)) * 3.0 / 1e4, 0) AS strat_net FROM s)"
for name, col, by in (("risk_metrics", "strat", "symbol"), ("cost_adjusted_metrics", "strat_net", "symbol"), ("regime_risk_metrics", "strat", "regime")):
    ctes, out = risk_sql(by, col, "st")
    add(name, lambda d, c=col, b=by: m.risk_metrics(m.strategy(d), c, [b]), out, ctes=STRAT + ctes)


def forecast_sql(by: str) -> tuple[str, str]:
    p = f"PARTITION BY {by} ORDER BY row_id"
    ctes = f", f1 AS (SELECT *, y - yhat AS e, (sign(y - coalesce(lag(y) OVER ({p}), 0)) = sign(yhat - coalesce(lag(yhat) OVER ({p}), 0)))::INT AS same, lead(y) OVER ({p}) * sign(yhat) AS nx FROM s WHERE yhat IS NOT NULL)"
    return ctes, f"SELECT {by}{'::BIGINT AS regime' if by == 'regime' else ''}, {r6('sqrt(avg(e * e))', 'rmse')}, {r6('avg(abs(e))', 'mae')}, {r6('1 - avg(e * e) / nullif(var_pop(y), 0)', 'r2')}, {r6('avg(same)', 'mda')}, {r6('avg((sign(y) = sign(yhat))::INT)', 'direction_accuracy')}, {r6('avg(nx) / (stddev_pop(nx) + 1e-10) * sqrt(252)', 'sharpe')}, {r6('avg(e) / nullif(stddev_samp(e), 0)', 'information_ratio')}, {r6('covar_pop(y, yhat) / nullif(stddev_pop(y) * stddev_pop(yhat), 0)', 'ic')} FROM f1 GROUP BY {by}"


for name, by in (("forecast_metrics", "symbol"), ("regime_forecast_metrics", "regime")):
    ctes, out = forecast_sql(by)
    add(name, lambda d, b=by: m.forecast_metrics(d, [b]), out, ctes=ctes)
add("rank_correlation", lambda d: m.rank_correlation(d, ["symbol"]), f"SELECT symbol, {r6('corr(a, b)', 'rank_correlation')} FROM (SELECT symbol, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS a, rank() OVER (ORDER BY yhat) + (count(*) OVER (PARTITION BY yhat) - 1) / 2.0 AS b FROM s WHERE yhat IS NOT NULL AND y IS NOT NULL) GROUP BY symbol")
add("regime_consistency", m.regime_consistency, f"SELECT {r6('greatest(least(1 - stddev_pop(k) / abs(avg(k)), 1), 0)', 'regime_consistency')} FROM (SELECT avg(y) / nullif(stddev_samp(y), 0) AS k FROM s GROUP BY regime)")
add("regime_summary", lambda d: m.summary(d, "y", ["regime"]), f"SELECT regime::BIGINT AS regime, {r6('avg(y)', 'mean')}, {r6('stddev_pop(y)', 'std')}, {r6('min(y)', 'min')}, {r6('max(y)', 'max')}, {r6('quantile_cont(y, 0.5)', 'median')}, {r6('quantile_cont(y, 0.05)', 'p5')}, {r6('quantile_cont(y, 0.95)', 'p95')}, {r6('quantile_cont(y, 0.75) - quantile_cont(y, 0.25)', 'iqr')}, {r6('stddev_pop(y) / nullif(avg(y), 0)', 'cv')} FROM s GROUP BY regime")
add("ks_statistic", lambda d: m.ks_statistic(d.where("row_id % 2 = 0"), d.where("row_id % 2 = 1"), "y"), f"SELECT {r6('max(abs(a - b))', 'ks')} FROM (SELECT (SELECT avg((q.y <= w.y)::INT) FROM s q WHERE q.row_id % 2 = 0) AS a, (SELECT avg((q.y <= w.y)::INT) FROM s q WHERE q.row_id % 2 = 1) AS b FROM (SELECT DISTINCT y FROM s WHERE y IS NOT NULL) w)")

FOLD = ", k AS (SELECT *, least(row_id // (n // 5), 4) AS fold FROM s), h AS (SELECT symbol, fold AS tf, min(row_id) AS r0, max(row_id) AS r1, min(ts) AS t0, max(ts) AS t1, arg_min(vol, row_id) AS v0 FROM k GROUP BY symbol, fold)"
ROLE = "SELECT symbol, row_id, tf::BIGINT AS fold, CASE WHEN fold = tf THEN 'test' ELSE 'train' END AS role FROM k JOIN h USING (symbol) WHERE fold = tf OR {keep}"
pick = lambda d: d.select("symbol", "row_id", "fold", "role")
add("kfold", lambda d: v.kfold(d).select("symbol", "row_id", "fold"), "SELECT symbol, row_id, fold::BIGINT AS fold FROM k", ctes=FOLD)
add("purged_by_days", lambda d: pick(v.purged_by_days(d)), ROLE.format(keep="ts < t0 - INTERVAL 5 DAY OR ts > t1 + INTERVAL 5 DAY"), ctes=FOLD)
add("purged_by_rows", lambda d: pick(v.purged_by_rows(d)), ROLE.format(keep="row_id < r0 - 10 OR row_id > r1 + 10"), ctes=FOLD)
add("purged_by_span", lambda d: pick(v.purged_by_span(d)), ROLE.format(keep="epoch(ts) < epoch(t0) - (epoch(t1) - epoch(t0)) * 0.01 OR epoch(ts) > epoch(t1) + (epoch(t1) - epoch(t0)) * 0.01"), ctes=FOLD)
DAYS = "to_days(greatest(5, floor(round(5 * least(greatest(v0 / (SELECT avg(vol) FROM s), 0.5), 3) * 2, 9)))::INT)"
add("adaptive_purge", lambda d: pick(v.adaptive_purge(d)), ROLE.format(keep=f"ts < t0 - {DAYS} OR ts > t1 + {DAYS}"), ctes=FOLD)
add("walk_forward_folds", lambda d: pick(v.walk_forward_folds(d)), "SELECT symbol, row_id, f::BIGINT AS fold, CASE WHEN row_id >= lo THEN 'test' ELSE 'train' END AS role FROM (SELECT symbol, row_id, f, st + f * sz AS lo, sz FROM (SELECT symbol, row_id, floor(round(n * 0.1, 6))::BIGINT AS sz, floor(round(n * 0.5, 6))::BIGINT AS st, unnest(range(0, ((n - floor(round(n * 0.5, 6))) // floor(round(n * 0.1, 6)))::BIGINT)) AS f FROM s)) WHERE (row_id >= lo AND row_id < lo + sz) OR row_id < lo - floor(sz * 0.1)")


def score_sql(assigned: str, by: str, out: str) -> str:
    return f", z AS ({assigned}), fit AS (SELECT {by}, regr_slope(y, yhat) AS a, regr_intercept(y, yhat) AS b FROM z WHERE role = 'train' AND yhat IS NOT NULL GROUP BY {by}), sc AS (SELECT {by}, sqrt(avg(power(y - b - a * yhat, 2))) AS rmse, count(*) AS n_test FROM z JOIN fit USING ({by}) WHERE role = 'test' AND yhat IS NOT NULL GROUP BY {by}){out}"


GRID = "SELECT symbol, p AS purge, e AS embargo, tf, y, yhat, CASE WHEN fold = tf THEN 'test' ELSE 'train' END AS role FROM k JOIN h USING (symbol), (SELECT unnest([0, 2, 5, 10, 15, 20, 30]) AS p), (SELECT unnest([0, 2, 5, 10, 15, 20, 30]) AS e) WHERE fold = tf OR ts < t0 - to_days(p) OR ts > t1 + to_days(e)"
add("purge_grid", v.purge_grid, f"SELECT symbol, purge::BIGINT AS purge, embargo::BIGINT AS embargo, round(avg(rmse), 6) AS rmse FROM sc GROUP BY ALL", ctes=FOLD + score_sql(GRID, "symbol, purge, embargo, tf", ""))
PB = "OVER (PARTITION BY symbol ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
add("walk_forward_ols", lambda d: v.walk_forward_ols(d).select("symbol", "row_id", "forecast"), "SELECT symbol, row_id, round(b + a * yhat, 6) AS forecast FROM w1 WHERE row_id >= floor(m * 0.3)", ctes=f", w1 AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS m, regr_slope(y, yhat) {PB} AS a, regr_intercept(y, yhat) {PB} AS b FROM s WHERE yhat IS NOT NULL AND y IS NOT NULL)")
COMBOS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {list(c)})" for i, c in enumerate(combinations(range(6), 3))) + ") AS t(combo, chosen)"
CPCV = f"SELECT symbol, combo, y, yhat, CASE WHEN list_contains(chosen, g) THEN 'test' ELSE 'train' END AS role FROM (SELECT *, least(row_id // (n // 6), 5) AS g FROM s), ({COMBOS}) WHERE list_contains(chosen, g) OR len(list_filter(chosen, lambda q: row_id >= q * (n // 6) - 5 AND row_id < CASE WHEN q = 5 THEN n ELSE (q + 1) * (n // 6) END + 5)) = 0"
add("cpcv", v.cpcv, "SELECT symbol, combo::BIGINT AS combo, round(rmse, 6) AS rmse, n_test FROM sc", ctes=score_sql(CPCV, "symbol, combo", ""))
PBO = """, dr AS (SELECT symbol, d, combo, round(rmse, 12) AS rmse, (d * 7919 + combo * 104729 + (d * combo + 7) * 1299709) % 1000003 AS hh
FROM sc, (SELECT unnest(range(0, 1000)) AS d)),
sd AS (SELECT *, row_number() OVER (PARTITION BY symbol, d ORDER BY hh, combo) % 2 AS side FROM dr),
ab AS (SELECT symbol, d, 0.5 * avg((sd.rmse > b.best)::INT) + 0.5 * avg((sd.rmse >= b.best)::INT) AS above FROM sd
JOIN (SELECT symbol, d, min(rmse) AS best FROM sd WHERE side = 1 GROUP BY ALL) b USING (symbol, d) WHERE side = 0 GROUP BY ALL)"""
OVERFIT = "SELECT symbol, round(avg((above < 0.5)::INT), 6) AS pbo FROM ab GROUP BY symbol"
add("backtest_overfit", lambda d: v.backtest_overfit(v.cpcv(d).withColumn("rmse", F.round("rmse", 12))), OVERFIT, ctes=score_sql(CPCV, "symbol, combo", PBO))
add("performance_decay", v.decay, "SELECT symbol, q AS quintile, round(rmse, 6) AS rmse, round(regr_slope(rmse, q) OVER (PARTITION BY symbol), 6) AS trend FROM (SELECT symbol, greatest(1, ceil(round(rn * 5 / (m - 1.0), 9)))::BIGINT AS q, sqrt(avg(power(y - yhat, 2))) AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY row_id) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS m FROM s WHERE yhat IS NOT NULL) GROUP BY 1, 2)")
MC = ", mc AS (SELECT *, sum((near = 0)::INT) OVER (PARTITION BY symbol, rep) AS free FROM (SELECT *, max(picked::INT) OVER (PARTITION BY symbol, rep ORDER BY row_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM (SELECT s.*, rep, (row_id * 48271 + rep * 69621 + row_id * rep * 16807) % 10007 < 8006 AS picked FROM s, (SELECT unnest(range(0, 100)) AS rep) WHERE yhat IS NOT NULL)))"
add("monte_carlo", v.monte_carlo, "SELECT symbol, rep, round(rmse, 6) AS rmse, n_test FROM sc", ctes=MC + score_sql("SELECT *, CASE WHEN picked THEN 'train' ELSE 'test' END AS role FROM mc WHERE picked OR free = 0 OR near = 0", "symbol, rep", ""))

"""Queries of losses, regimes, selection, recursive indicators, transforms and tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import rounded
from ..operators import fits as ft
from ..operators import indicators as ti
from ..operators import loss as lo
from ..operators import blocks as bk
from ..operators import recursive as rc
from ..operators import regimes as rg
from ..operators import series as sr
from ..operators import tuning as tn
from ..operators import unitroot as ur
from ..operators import variance as va
from ..operators import volatility as vo
from ..sources.bars import order_bars, tick_panel
from ..sources.samples import samples
from .sqltext import adf_p_sql, ORDER_BARS, SERIES, bars_sql, lag, last
from .validation import SAMPLES, tidy

Q, SQL = {}, {}


def add(name, make, sql=None, digits=6, ctes=""):
    Q[name] = lambda spark, sf: tidy(make(samples(spark, sf)), digits)
    if sql:
        SQL[name] = f"WITH {SAMPLES}{ctes} {sql}"


NAMES = {1: "trending_up", 2: "low_liquidity", 3: "range_bound", 4: "none"}
named = lambda d: d.withColumn("regime_name", F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("regime").cast("int")))
CLIP = "least(greatest(r / greatest(vol, 1e-8), -3), 3) * greatest(vol, 1e-8)"
sp = lambda e: f"(CASE WHEN {e} > 20 THEN {e} ELSE ln(1 + exp(least({e}, 20))) END)"


def loss_ctes(z: str, base: str, weight: str) -> str:
    return f""", l1 AS (SELECT *, y - yhat AS r FROM s WHERE yhat IS NOT NULL), l2 AS (SELECT *, {z} AS z, CASE regime WHEN 1 THEN 1.2 WHEN 2 THEN 1.8 WHEN 3 THEN 1.5 ELSE 1.0 END * 1.35 * greatest(vol, 1e-8) AS dl FROM l1),
l3 AS (SELECT *, count(z) OVER (PARTITION BY symbol, batch_id) AS nb, count(*) FILTER (z < 0) OVER (PARTITION BY symbol, batch_id) AS nn, avg(volume) OVER (PARTITION BY symbol, batch_id) AS av FROM l2),
l4 AS (SELECT *, {weight} AS w, {base} AS base FROM l3)"""


HUBER = "CASE WHEN abs(z) <= dl THEN 0.5 * z * z ELSE dl * (abs(z) - 0.5 * dl) END"
QH = "CASE WHEN abs(z) <= dl THEN 0.5 * power(CASE WHEN z >= 0 THEN 0.7 * z ELSE -0.3 * z END, 2) / dl ELSE CASE WHEN z >= 0 THEN 0.7 * z ELSE (0.7 - 1) * z END * (abs(z) - 0.5 * dl) END"
side = lambda a, m: f"CASE WHEN {m} = 0 THEN 0.1 ELSE least(greatest({a} * nb / {m}, 0.1), 10) END"
ASYM = f"CASE WHEN z < 0 THEN {side(0.5, 'nn')} ELSE {side(0.5, '(nb - nn)')} END * (volume / nullif(av, 0))"
ROWS = "SELECT symbol, row_id, round(z, 12) AS winsorized, round(dl, 12) AS delta, round(w, 12) AS weight, round(base * w, 12) AS loss FROM l4"
cols = lambda d: d.select("symbol", "row_id", "winsorized", "delta", "weight", "loss")
add("loss_huber", lambda d: cols(lo.losses(named(d))), ROWS, 12, loss_ctes(CLIP, HUBER, ASYM))
LOW = sp("(r / greatest(vol, 1e-8) + 3)")
SOFT = f"(3 - {sp(f'(3 - (-3 + {LOW}))')}) * greatest(vol, 1e-8)"
add("loss_soft_clamp", lambda d: cols(lo.losses(named(d), lo.LossConfig(soft=True))), ROWS, 12, loss_ctes(SOFT, HUBER, ASYM))
add("loss_quantile_huber", lambda d: cols(lo.losses(named(d), lo.LossConfig(quantile=0.7))), ROWS, 12, loss_ctes(CLIP, QH, "volume / nullif(av, 0)"))
add("loss_by_batch", lambda d: lo.reduce_losses(lo.losses(named(d)), ["symbol", "batch_id"]), "SELECT symbol, batch_id, round(avg(base * w), 8) AS mean_loss, round(sum(base * w), 8) AS sum_loss, count(*) AS n FROM l4 GROUP BY symbol, batch_id", 8, loss_ctes(CLIP, HUBER, ASYM))
add("loss_quantile_buffer", lambda d: lo.quantile_buffer(d, "y", 0.95).select("symbol", "row_id", "buffer_quantile"), "SELECT symbol, row_id, round(last_value(fresh IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS buffer_quantile FROM (SELECT symbol, row_id, CASE WHEN row_id % 100 = 0 THEN list_sort(v)[floor(0.95 * (len(v) - 1))::INT + 1] END AS fresh FROM (SELECT symbol, row_id, list(y) OVER (PARTITION BY symbol ORDER BY row_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS v FROM s))")

TM = "SELECT q.symbol, q.a::BIGINT AS from_state, q.b::BIGINT AS to_state, round(coalesce(coalesce(m.n, 0) / sum(m.n) OVER (PARTITION BY q.symbol, q.a), 1.0 / k), 6) AS prob FROM (SELECT x.symbol, x.regime AS a, w.regime AS b, count(*) OVER (PARTITION BY x.symbol, x.regime) AS k FROM (SELECT DISTINCT symbol, regime FROM s) x JOIN (SELECT DISTINCT symbol, regime FROM s) w USING (symbol)) q LEFT JOIN (SELECT symbol, a, b, count(*) AS n FROM (SELECT symbol, regime AS a, lead(regime) OVER (PARTITION BY symbol ORDER BY row_id) AS b FROM s) WHERE b IS NOT NULL GROUP BY ALL) m ON q.symbol = m.symbol AND q.a = m.a AND q.b = m.b"
add("transition_matrix", lambda d: rg.transition_matrix(d, "regime"), TM)
MODE = lambda n: f"list_sort(list_transform(list_distinct(v{n}), lambda q: {{'n': -len(list_filter(v{n}, lambda z: z = q)), 's': q}}))[1].s::BIGINT"
add("regime_mode", lambda d: rg.rolling_mode(d, "regime").select("symbol", "row_id", "regime_mode_20", "regime_mode_50"), f"SELECT symbol, row_id, {MODE(20)} AS regime_mode_20, {MODE(50)} AS regime_mode_50 FROM (SELECT symbol, row_id, list(regime) {last(20)} AS v20, list(regime) {last(50)} AS v50 FROM s)")
add("change_segments", lambda d: rg.segments(d, F.col("row_id") % 500 == 499).select("symbol", "row_id", "segment_id", "regime_id"), "SELECT symbol, row_id, k AS segment_id, greatest(k - 1, 0)::BIGINT AS regime_id FROM (SELECT symbol, row_id, sum((row_id % 500 = 499)::INT) OVER (PARTITION BY symbol ORDER BY row_id)::BIGINT AS k FROM s)")
MI = ", bn AS (SELECT ntile(5) OVER (ORDER BY y NULLS FIRST, row_id) AS t, ntile(5) OVER (ORDER BY yhat NULLS FIRST, row_id) AS yhat, ntile(5) OVER (ORDER BY vol NULLS FIRST, row_id) AS vol, ntile(5) OVER (ORDER BY mom NULLS FIRST, row_id) AS mom, ntile(5) OVER (ORDER BY volume NULLS FIRST, row_id) AS volume FROM s), lg AS (SELECT t, feature, b FROM bn UNPIVOT (b FOR feature IN (yhat, vol, mom, volume))), jt AS (SELECT feature, b, t, count(*) AS n FROM lg GROUP BY ALL)"
FEATURES = ["yhat", "vol", "mom", "volume"]
add("mutual_information", lambda d: rg.mutual_information(d, FEATURES, "y"), "SELECT feature, round(sum(n / tn * ln(n * tn / (bn_ * tt))), 6) AS mi FROM (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS tn, sum(n) OVER (PARTITION BY feature, b) AS bn_, sum(n) OVER (PARTITION BY feature, t) AS tt FROM jt) GROUP BY feature", 6, MI)


def _scores(d):
    mi = rg.mutual_information(d, FEATURES, "y").withColumnRenamed("mi", "importance")
    r = F.abs(F.try_divide(F.covar_pop("v", "y"), F.stddev_pop("v") * F.stddev_pop("y")))
    long = d.where("yhat is not null").select("y", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in FEATURES])).alias("x")).select("y", "x.*")
    return rg.ensemble_scores(mi.union(long.groupBy("feature").agg(r.alias("importance"))), 2, 3)


add("feature_scores", _scores, "SELECT feature, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 10) DESC, feature) AS rank FROM (SELECT feature, 0.5 * count(*) / 2 + 0.5 * avg(importance) AS score FROM (SELECT feature, sum(n / tn * ln(n * tn / (bn_ * tt))) AS importance FROM (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS tn, sum(n) OVER (PARTITION BY feature, b) AS bn_, sum(n) OVER (PARTITION BY feature, t) AS tt FROM jt) GROUP BY feature UNION ALL SELECT feature, abs(corr(v, y)) FROM (SELECT y, yhat, vol, mom, volume FROM s WHERE yhat IS NOT NULL) UNPIVOT (v FOR feature IN (yhat, vol, mom, volume)) GROUP BY feature) GROUP BY feature) ORDER BY score DESC LIMIT 3", 6, MI)
add("kmeans_regimes", lambda d: rg.kmeans_regimes(d.where("mom is not null"), ["vol", "mom"]).select("symbol", "row_id", "regime_kmeans"))
add("forest_importance", lambda d: rg.forest_importance(d, FEATURES, "y"))
add("lasso_importance", lambda d: rg.lasso_importance(d, FEATURES, "y"))
TRIALS = ", tr AS (SELECT batch_id AS trial_id, round(avg(y), 8) AS gain, round(stddev_pop(y), 8) AS risk FROM s GROUP BY batch_id)"
trials = lambda d: d.groupBy(F.col("batch_id").alias("trial_id")).agg(F.round(F.avg("y"), 8).alias("gain"), F.round(F.stddev_pop("y"), 8).alias("risk"))
add("pareto_front", lambda d: rg.pareto_front(trials(d), "gain", "risk").select("trial_id", "gain", "risk"), "SELECT trial_id, gain, risk FROM tr a WHERE NOT EXISTS (SELECT 1 FROM tr b WHERE b.gain >= a.gain AND b.risk <= a.risk AND (b.gain > a.gain OR b.risk < a.risk))", 8, TRIALS)


def bar(name, make, stages, out, digits=6, more=""):
    Q[name] = lambda spark, sf: rounded(make(order_bars(spark, sf)), list(out), digits)
    if stages is not None:
        SQL[name] = bars_sql(ORDER_BARS, stages, out, digits, more)


def recursive(step: str, first: str, extra: str = "") -> str:
    """SQL of a scan over rows in order: n counts them from 1."""
    return f"WITH RECURSIVE {ORDER_BARS}, o AS (SELECT *, row_number() {SERIES} AS n, {lag('close')} AS pc{extra} FROM b0), z AS (SELECT symbol, ts, n, {first} FROM o WHERE n = 1 UNION ALL SELECT o.symbol, o.ts, o.n, {step} FROM z JOIN o ON o.symbol = z.symbol AND o.n = z.n + 1)"


bar("moving_averages", lambda d: bk.moving_averages(d, block=500), None, dict.fromkeys(["ema_fast", "ema_slow", "macd", "macd_signal", "macd_diff", "ppo", "trix", "tsi"]), 4)
E = lambda c, x, n: f"z.{c} + 2.0 / ({n} + 1) * ({x} - z.{c})"
A, B = E("a", "o.close", 12), E("b", "o.close", 26)
T1 = E("t1", "o.close", 15)
T2 = E("t2", f"({T1})", 15)
T3 = E("t3", f"({T2})", 15)
W25 = lambda c, x: f"CASE WHEN z.{c} IS NULL THEN {x} ELSE {E(c, x, 25)} END"
D1, D2 = W25("d1", "(o.close - o.pc)"), W25("e1", "abs(o.close - o.pc)")
W13 = lambda c, x: f"CASE WHEN z.{c} IS NULL THEN ({x}) ELSE {E(c, f'({x})', 13)} END"
SQL["moving_averages"] = recursive(f"{A}, {B}, {E('g', f'(({A}) - ({B}))', 9)}, {T1}, {T2}, {T3}, z.t3, {D1}, {D2}, {W13('d2', D1)}, {W13('e2', D2)}", "close AS a, close AS b, 0.0::DOUBLE AS g, close AS t1, close AS t2, close AS t3, NULL::DOUBLE AS p3, NULL::DOUBLE AS d1, NULL::DOUBLE AS e1, NULL::DOUBLE AS d2, NULL::DOUBLE AS e2") + " SELECT symbol, ts, round(a, 4) AS ema_fast, round(b, 4) AS ema_slow, round(a - b, 4) AS macd, round(g, 4) AS macd_signal, round(a - b - g, 4) AS macd_diff, round(100 * (a - b) / nullif(b, 0), 4) AS ppo, round(100 * (t3 / nullif(p3, 0) - 1), 4) AS trix, round(100 * d2 / nullif(e2, 0), 4) AS tsi FROM z"
bar("wilder_indicators", lambda d: bk.wilder_indicators(d, block=500), None, dict.fromkeys(["atr", "rsi", "dm_plus", "dm_minus", "di_plus", "di_minus", "dx", "adx"]), 4)
SRC = f", greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr, greatest(close - {lag('close')}, 0) AS gn, greatest({lag('close')} - close, 0) AS ls, high - {lag('high')} AS u, {lag('low')} - low AS w"
X = {"tr": "o.tr", "gn": "o.gn", "ls": "o.ls", "p": "CASE WHEN o.u > o.w AND o.u > 0 THEN o.u ELSE 0 END", "m": "CASE WHEN o.w > o.u AND o.w > 0 THEN o.w ELSE 0 END"}
# Sums of the first 14 known values become their mean on row 15; later rows smooth.
WS = lambda c: f"CASE WHEN o.n <= 15 THEN (z.{c} + {X[c]}) / CASE WHEN o.n = 15 THEN 14 ELSE 1 END ELSE (z.{c} * 13 + {X[c]}) / 14 END"
pc = lambda e: f"(100 * ({e}) / nullif({WS('tr')}, 0))"
DX = f"(100 * abs({pc(WS('p'))} - {pc(WS('m'))}) / nullif({pc(WS('p'))} + {pc(WS('m'))}, 0))"
SQL["wilder_indicators"] = recursive(f"{WS('tr')}, {WS('gn')}, {WS('ls')}, {WS('p')}, {WS('m')}, CASE WHEN o.n < 15 THEN 0 WHEN o.n <= 28 THEN (z.ax + {DX}) / CASE WHEN o.n = 28 THEN 14 ELSE 1 END ELSE (z.ax * 13 + {DX}) / 14 END", "0.0::DOUBLE AS tr, 0.0::DOUBLE AS gn, 0.0::DOUBLE AS ls, 0.0::DOUBLE AS p, 0.0::DOUBLE AS m, 0.0::DOUBLE AS ax", SRC) + " SELECT symbol, ts, round(CASE WHEN n >= 15 THEN tr END, 4) AS atr, round(CASE WHEN n >= 15 THEN CASE WHEN ls = 0 THEN 100 ELSE 100 - 100 / (1 + gn / nullif(ls, 0)) END END, 4) AS rsi, round(CASE WHEN n >= 15 THEN p END, 4) AS dm_plus, round(CASE WHEN n >= 15 THEN m END, 4) AS dm_minus, round(CASE WHEN n >= 15 THEN 100 * p / nullif(tr, 0) END, 4) AS di_plus, round(CASE WHEN n >= 15 THEN 100 * m / nullif(tr, 0) END, 4) AS di_minus, round(CASE WHEN n >= 15 THEN 100 * abs(100 * p / nullif(tr, 0) - 100 * m / nullif(tr, 0)) / nullif(100 * p / nullif(tr, 0) + 100 * m / nullif(tr, 0), 0) END, 4) AS dx, round(CASE WHEN n >= 28 THEN ax END, 4) AS adx FROM z"
bar("adaptive_averages", rc.adaptive_averages, None, dict.fromkeys(["kama", "vidya", "zlema", "fisher", "psar", "kvo", "chaikin", "mass"]), 4)
bar("garch_filter", lambda d: bk.garch_filter(d, block=500), None, {"garch_var": None})
SQL["garch_filter"] = recursive("1e-3 + 0.08 * power(z.r, 2) + 0.9 * z.h, ln(o.close / o.pc)", "(SELECT var_pop(q) FROM (SELECT coalesce(ln(close / pc), 0) AS q FROM o)) AS h, 0.0::DOUBLE AS r") + " SELECT symbol, ts, round(h, 6) AS garch_var FROM z"
WEIGHTS = [1.0]
for _k in range(1, 50):
    WEIGHTS.append(WEIGHTS[-1] * (0.4 - _k + 1) / _k)
bar("frac_diff", lambda d: rc.frac_diff(d, "close"), [{"v": f"list(close) {last(50)}"}], {"frac_diff_close": "CASE WHEN len(v) = 50 THEN list_dot_product(list_reverse(v), [" + ", ".join(repr(w) for w in WEIGHTS) + "]::DOUBLE[]) END"}, 3)
Q["adf_statistic"] = lambda spark, sf: tidy(rc.adf(order_bars(spark, sf)), 4)
SQL["adf_statistic"] = f"WITH {ORDER_BARS}, d AS (SELECT symbol, {lag('close')} AS b, close - {lag('close')} AS d FROM b0) SELECT symbol, round(regr_slope(d, b) / sqrt((1 - regr_r2(d, b)) * var_pop(d) / ((count(*) - 2) * var_pop(b))), 4) AS adf_stat FROM d WHERE b IS NOT NULL GROUP BY symbol"


def wide_frame(d):
    """The wide feature frame: all native families in a few projections."""
    d = vo.tail_risk(vo.vol_dynamics(vo.range_volatility(vo.ranges(vo.rolling_volatility(vo.returns(d))))))
    return ti.oscillators(ti.money_flow(ti.stochastic(ti.bollinger(ti.prices(d)))))


def _panel(spark, sf):
    """Window features over the wide panel of suppliers' price series: one shuffle by symbol for all frames."""
    d = vo.vol_dynamics(vo.rolling_volatility(vo.returns(tick_panel(spark, sf))))
    return d.select("symbol", F.col("ts.l_shipdate").alias("ts"), F.col("ts.l_orderkey").alias("order_key"), F.col("ts.l_linenumber").cast("long").alias("line"), F.col("ts.l_partkey").alias("part_key"), *[F.round(x, 6).alias(x) for x in ("returns", "rolling_vol_20", "vol_deviation")])


Q["tick_panel_features"] = _panel
SQL["tick_panel_features"] = """WITH b0 AS (SELECT l_suppkey::VARCHAR AS symbol, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS close FROM lineitem),
b1 AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS returns, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) ELSE 0 END AS r FROM b0 WINDOW w AS (PARTITION BY symbol ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey)),
b2 AS (SELECT *, stddev_pop(r) OVER (PARTITION BY symbol ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v FROM b1),
b3 AS (SELECT *, CASE WHEN count(v) OVER w = 20 THEN avg(v) OVER w END AS m FROM b2 WINDOW w AS (PARTITION BY symbol ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT symbol, l_shipdate AS ts, l_orderkey AS order_key, l_linenumber::BIGINT AS line, l_partkey AS part_key, round(returns, 6) AS returns, round(v, 6) AS rolling_vol_20, round((v - m) / nullif(m, 0), 6) AS vol_deviation FROM b3"""

bar("spectrum", lambda d: sr.spectrum(d, block=500), None, dict.fromkeys(["spectral_entropy", "dominant_freq", "dominant_power"]), 4)
bar("wavelet_energy", sr.wavelet, None, dict.fromkeys([f"wavelet_energy_level_{i}" for i in range(1, 6)]))
bar("change_points", sr.change_points, None, {"is_change": None})
bar("hidden_states", sr.hidden_states, None, {"regime_hmm": None})
add("sensitivity", lambda d: tn.sensitivity(d, 0.01), "SELECT symbol, round(p, 6) AS penalty, round(sqrt(avg(power(y - my - n1 * cxy / (n1 * vx + p) * (yhat - mx), 2))), 6) AS rmse FROM sp WHERE rn > cut GROUP BY symbol, p", 6, ", sq AS (SELECT *, floor(count(*) OVER (PARTITION BY symbol) * 0.8) AS cut, row_number() OVER (PARTITION BY symbol ORDER BY row_id) AS rn FROM s WHERE yhat IS NOT NULL AND y IS NOT NULL), sp AS (SELECT sq.*, p, f.* EXCLUDE (symbol) FROM sq JOIN (SELECT symbol, count(*) AS n1, avg(yhat) AS mx, avg(y) AS my, covar_pop(yhat, y) AS cxy, var_pop(yhat) AS vx FROM sq WHERE rn <= cut GROUP BY symbol) f USING (symbol), (SELECT unnest(list_transform(range(0, 10), lambda i: 0.01::DOUBLE * (1 - 0.2 + 0.4 * i / 9))) AS p))")
as_trials = lambda d: d.groupBy(F.col("batch_id").alias("trial_id")).agg(F.round(F.avg("y"), 8).alias("value"), F.create_map(F.lit("vol"), F.round(F.avg("vol"), 8), F.lit("mom"), F.round(F.avg("mom"), 8)).alias("params")).withColumn("state", F.lit("COMPLETE"))
add("trial_meta", lambda d: tn.meta_knowledge(as_trials(d)), "SELECT param, round(corr(a, b), 6) AS correlation, round(min(x) FILTER (k <= ceil(n * 0.1)), 6) AS best_min, round(max(x) FILTER (k <= ceil(n * 0.1)), 6) AS best_max, round(quantile_cont(x, 0.5) FILTER (k <= ceil(n * 0.1)), 6) AS best_median FROM (SELECT *, rank() OVER (PARTITION BY param ORDER BY x) + (count(*) OVER (PARTITION BY param, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY param ORDER BY value) + (count(*) OVER (PARTITION BY param, value) - 1) / 2.0 AS b, row_number() OVER (PARTITION BY param ORDER BY value DESC, trial_id) AS k, count(*) OVER (PARTITION BY param) AS n FROM tp) GROUP BY param", 6, ", tp AS (SELECT * FROM (SELECT batch_id AS trial_id, round(avg(y), 8) AS value, round(avg(vol), 8) AS vol, round(avg(mom), 8) AS mom FROM s GROUP BY batch_id) UNPIVOT (x FOR param IN (vol, mom)))")

bar("garch_fit", ft.garch, None, dict.fromkeys(["garch_vol", "garch_alpha", "garch_beta", "garch_forecast"]))
bar("variance_features", lambda d: va.variance_features(d, block=1001), None, dict.fromkeys(["garch_vol", "garch_alpha", "garch_beta", "garch_forecast", "vol_of_vol", "egarch_vol", "vol_asymmetry"]))
bar("asymmetric_variance", lambda d: va.variance_model(va.variance_model(d, "gjr", block=1001), "tgarch", block=1001), None, dict.fromkeys([f"{v}_{c}" for v in ("gjr", "tgarch") for c in ("vol", "alpha", "beta", "gamma", "forecast")]))
bar("rolling_pca", lambda d: ft.rolling_pca(d, ["open", "high", "low", "close", "volume"], block=500), None, dict.fromkeys(["pca_component_1", "pca_component_2", "pca_exp_var_ratio_1", "pca_exp_var_ratio_2"]), 4)
bar("box_cox", lambda d: ft.box_cox(d, "close"), None, {"box_cox_lambda": None, "box_cox_close": None}, 4)
Q["kpss_statistic"] = lambda spark, sf: tidy(ft.kpss(order_bars(spark, sf)), 6)
SQL["kpss_statistic"] = f"WITH {ORDER_BARS}, e AS (SELECT *, close - avg(close) OVER (PARTITION BY symbol) AS e FROM b0), q AS (SELECT *, sum(e) OVER (PARTITION BY symbol ORDER BY ts) AS s, " + ", ".join(f"lag(e, {k}) {SERIES} AS l{k}" for k in range(1, 11)) + " FROM e) SELECT symbol, round((sum(s * s) / (count(*) * count(*))) / (sum(e * e) / count(*) + " + " + ".join(f"2 * (1 - {k} / 11.0) * sum(e * l{k}) / count(*)" for k in range(1, 11)) + "), 6) AS kpss_stat FROM q GROUP BY symbol"

Q["stationarity"] = lambda spark, sf: ur.stationarity(order_bars(spark, sf)).select("symbol", *[F.round(c, 4).alias(c) for c in ("adf_stat", "adf_p", "kpss_stat", "kpss_p")], *[F.col(c).cast("int").alias(c) for c in ("adf_stationary", "kpss_stationary", "conflict")])
_AT = list(zip(ur.KPSS_AT, ur.KPSS_P, strict=True))
_BETWEEN = " ".join(f"WHEN k <= {b} THEN {p} + (k - {a}) / ({b} - {a}) * ({q} - {p})" for (a, p), (b, q) in zip(_AT, _AT[1:], strict=False))
_BOTH = f"SELECT symbol, adf_stat AS a, kpss_stat AS k FROM ({SQL['adf_statistic'].replace(', 4) AS adf_stat', ', 15) AS adf_stat')}) JOIN ({SQL['kpss_statistic'].replace(', 6) AS kpss_stat', ', 15) AS kpss_stat')}) USING (symbol)"
SQL["stationarity"] = f"SELECT symbol, round(a, 4) AS adf_stat, round(p, 4) AS adf_p, round(k, 4) AS kpss_stat, round(kp, 4) AS kpss_p, (p < 0.05)::INT AS adf_stationary, (kp >= 0.05)::INT AS kpss_stationary, ((p < 0.05) <> (kp >= 0.05))::INT AS conflict FROM (SELECT *, {adf_p_sql('a')} AS p, CASE WHEN k <= {_AT[0][0]} THEN {_AT[0][1]} {_BETWEEN} ELSE {_AT[-1][1]} END AS kp FROM ({_BOTH}))"

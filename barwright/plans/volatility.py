"""Queries of returns, ranges, volatility and tail risk."""

from __future__ import annotations

from ..functions.windows import rounded
from ..operators import volatility as v
from ..sources.bars import event_bars, order_bars
from .sqltext import EVENT_BARS, ORDER_BARS, SERIES, SO_FAR, WHOLE, bars_sql, lag, last, roll, sma

Q, SQL = {}, {}
R = {"returns": f"close / nullif({lag('close')}, 0) - 1", "log_returns": f"CASE WHEN close > 0 AND {lag('close')} > 0 THEN ln(close / {lag('close')}) END"}
R0 = {"r": "coalesce(log_returns, 0)"}


def add(name, bars, make, cols, sql):
    Q[name] = lambda spark, sf, m=make, b=bars, c=cols: rounded(m(b(spark, sf)), c)
    SQL[name] = sql


add("returns_basic", event_bars, v.returns, ["returns", "log_returns"], bars_sql(EVENT_BARS, [R], {n: n for n in R}))

VOL = {f"rolling_vol_{w}": f"stddev_pop(r) {last(w)}" for w in (5, 20, 60)}
vol = lambda d: v.rolling_volatility(v.returns(d))
add("rolling_volatility", order_bars, vol, [*VOL, *(f"rolling_vol_annual_{w}" for w in (5, 20, 60))], bars_sql(ORDER_BARS, [R, R0, VOL], {n: n for n in VOL} | {f"rolling_vol_annual_{w}": f"rolling_vol_{w} * sqrt(252)" for w in (5, 20, 60)}))

RANGE = {"hl": "CASE WHEN low > 0 AND high > 0 THEN ln(high / low) END", "co": "CASE WHEN open > 0 AND close > 0 THEN ln(close / open) ELSE 0 END"}
GK = {"gk": "0.5 * hl * hl - (2 * ln(2) - 1) * co * co"}
root = lambda e: f"CASE WHEN round({e}, 12) >= 0 THEN sqrt(abs({e})) END"
add("bar_ranges", event_bars, v.ranges, ["high_low_range", "high_low_range_pct", "parkinson_vol", "garman_klass_vol"], bars_sql(EVENT_BARS, [RANGE, GK], {"high_low_range": "high - low", "high_low_range_pct": "(high - low) / nullif(close, 0)", "parkinson_vol": "sqrt(hl * hl / (4 * ln(2)))", "garman_klass_vol": root("gk")}))
W3 = (5, 20, 60)
add("range_volatility", order_bars, lambda d: v.range_volatility(v.ranges(d)), [*(f"parkinson_vol_{w}" for w in W3), *(f"garman_klass_vol_{w}" for w in W3)], bars_sql(ORDER_BARS, [RANGE, GK, {f"p{w}": f"avg(hl * hl / (4 * ln(2))) {last(w)}" for w in W3} | {f"g{w}": f"avg(gk) {last(w)}" for w in W3}], {f"parkinson_vol_{w}": f"sqrt(p{w})" for w in W3} | {f"garman_klass_vol_{w}": root(f"g{w}") for w in W3}))

PCT = {"vs": f"list(round(rolling_vol_20, 10)) {last(252)}", "x": "round(rolling_vol_20, 10)"}
P = {"vol_percentile": "CASE WHEN len(vs) = 252 THEN (len(list_filter(vs, lambda q: q < x)) + (len(list_filter(vs, lambda q: q = x)) + 1) / 2.0) / 252 END"}
pct = lambda d: v.vol_percentile(vol(d))
add("vol_percentile", order_bars, pct, ["vol_percentile"], bars_sql(ORDER_BARS, [R, R0, VOL, PCT, P], {"vol_percentile": "vol_percentile"}))
E = {"y": "round(coalesce(vol_percentile, 0.5), 10)"}
EDGES = {f"e{i}": f"round(quantile_cont(y, {i / 5}) {WHOLE}, 10)" for i in range(1, 5)}
N = {"n": " + ".join(f"(y > e{i})::INT" for i in range(1, 5))}
add("vol_regime", order_bars, lambda d: v.vol_regime(pct(d)), ["vol_regime_numeric", "vol_regime"], bars_sql(ORDER_BARS, [R, R0, VOL, PCT, P, E, EDGES, N], {"vol_regime_numeric": "#n", "vol_regime": "=['very_low', 'low', 'medium', 'high', 'very_high'][n + 1]"}))
add("vol_dynamics", order_bars, lambda d: v.vol_dynamics(vol(d)), ["vol_acceleration", "vol_deviation", "vol_term_structure"], bars_sql(ORDER_BARS, [R, R0, VOL, {"m": sma("rolling_vol_20", 20), "b": lag("rolling_vol_20", 5)}], {"vol_acceleration": "rolling_vol_20 / nullif(b, 0) - 1", "vol_deviation": "(rolling_vol_20 - m) / nullif(m, 0)", "vol_term_structure": "rolling_vol_5 / nullif(rolling_vol_60, 0)"}))
add("vol_seasonality", order_bars, lambda d: v.vol_seasonality(vol(d)), ["vol_day_factor", "vol_month_factor"], bars_sql(ORDER_BARS, [R, R0, VOL], {"vol_day_factor": f"avg(rolling_vol_20) OVER (PARTITION BY symbol, isodow(ts)) / avg(rolling_vol_20) {WHOLE}", "vol_month_factor": f"avg(rolling_vol_20) OVER (PARTITION BY symbol, month(ts)) / avg(rolling_vol_20) {WHOLE}"}))

T1 = {"q": "round(coalesce(returns, 0), 10)"}
T2 = {"v95": f"quantile_cont(q, 0.05) {last(252)}", "v99": f"quantile_cont(q, 0.01) {last(252)}", "n": f"count(q) {last(252)}", "p": f"list(q) {last(252, 1)}", "sd": f"stddev_samp(q) {last(252)}"}
T3 = {"cv": "CASE WHEN len(p) = 252 THEN list_avg(list_filter(p, lambda z: z <= round(v95, 10))) ELSE 0 END"}
add("tail_risk", order_bars, lambda d: v.tail_risk(v.returns(d)), ["var_95", "var_99", "cvar_95", "tail_risk_ratio"], bars_sql(ORDER_BARS, [R, T1, T2, T3], {"var_95": "CASE WHEN n = 252 THEN v95 END", "var_99": "CASE WHEN n = 252 THEN v99 END", "cvar_95": "cv", "tail_risk_ratio": "CASE WHEN n = 252 THEN cv / nullif(sd, 0) END"}))
add("drawdown", order_bars, lambda d: v.drawdown(v.returns(d)), ["drawdown"], bars_sql(ORDER_BARS, [R, {"g": f"product(1 + coalesce(returns, 0)) {SO_FAR}"}], {"drawdown": f"g / greatest(max(g) {SO_FAR}, 1) - 1"}))

LAGS = range(2, 20)
H1 = {f"d{i}": f"close - {lag('close', i)}" for i in LAGS} | {"i": f"row_number() {SERIES}"}
H2 = {f"t{i}": f"stddev_pop(d{i}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {100 - i} PRECEDING AND 1 PRECEDING)" for i in LAGS}
H3 = {"h": "CASE WHEN i > 100 THEN 2 * (SELECT regr_slope(y, x) FROM (SELECT unnest([" + ", ".join(f"log10(sqrt(nullif(t{i}, 0)))" for i in LAGS) + "]) AS y, unnest([" + ", ".join(f"log10({i})" for i in LAGS) + "]) AS x)) ELSE 0 END"}
add("hurst", order_bars, v.hurst, ["hurst_exponent", "fractal_dimension", "self_similarity"], bars_sql(ORDER_BARS, [H1, H2, H3], {"hurst_exponent": "h", "fractal_dimension": "2 - h", "self_similarity": "CASE WHEN round(h, 10) > 0.5 THEN (h - 0.5) * 5 WHEN round(h, 10) = 0.5 THEN 1.0 ELSE 0.0 END"}))
C1 = {"x2": lag("close", 2), "x1": lag("close", 1), "i": f"row_number() {SERIES}"}
C2 = {"c": "CASE WHEN x2 IS NULL THEN NULL WHEN x2 <= x1 AND x1 <= close THEN 0 WHEN x2 <= close AND close < x1 THEN 1 WHEN x1 < x2 AND x2 <= close THEN 2 WHEN close < x2 AND x2 <= x1 THEN 3 WHEN x1 <= close AND close < x2 THEN 4 ELSE 5 END"}
FR = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 98 PRECEDING AND 1 PRECEDING)"
C3 = {f"p{k}": f"count(*) FILTER (c = {k}) {FR} / 98.0" for k in range(6)}
add("perm_entropy", event_bars, v.permutation_entropy, ["perm_entropy"], bars_sql(EVENT_BARS, [C1, C2, C3], {"perm_entropy": "CASE WHEN i > 100 THEN (" + " + ".join(f"CASE WHEN p{k} > 0 THEN -p{k} * log2(p{k}) ELSE 0 END" for k in range(6)) + ") / log2(6) END"}))
S1 = {"i": f"row_number() {SERIES}"}
S2 = {"a": "CASE WHEN i % 2 = 0 THEN close ELSE -close END"}
add("spectral_density", event_bars, v.spectral_density, ["spectral_density"], bars_sql(EVENT_BARS, [S1, S2], {"spectral_density": f"CASE WHEN i > 100 THEN (100 * sum(close * close) {last(100, 1)} + power(sum(close) {last(100, 1)}, 2) + power(sum(a) {last(100, 1)}, 2)) / 2 ELSE 0 END"}, digits=0))
Q["spectral_density"] = lambda spark, sf: rounded(v.spectral_density(event_bars(spark, sf)), ["spectral_density"], 0)
add("zscore_close", order_bars, lambda d: v.standardized(d, "close"), ["zscore_close"], bars_sql(ORDER_BARS, [{"m": sma("close", 100), "sd": roll("stddev_samp(close)", "close", 100)}], {"zscore_close": "CASE WHEN round(sd, 12) = 0 THEN 0 ELSE (close - m) / nullif(sd, 0) END"}))

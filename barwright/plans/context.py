"""Queries of calendar and cross-asset features."""

from __future__ import annotations

from ..functions.windows import rounded
from ..operators import calendar as c
from ..operators import crossasset as x
from ..operators import unitroot as u
from ..sources.bars import event_bars, order_bars, ship_bars
from .sqltext import adf_p_sql, EVENT_BARS, ORDER_BARS, SERIES, SHIP_BARS, SO_FAR, bars_sql, lag, last, roll

Q, SQL = {}, {}
#: The columns of each query but symbol and ts.
OUT: dict[str, list[str]] = {}


def add(name, make, stages, out, digits=6, bars="order", more=""):
    source, text = (order_bars, ORDER_BARS) if bars == "order" else (event_bars, EVENT_BARS)
    OUT[name] = list(out)
    Q[name] = lambda spark, sf: rounded(make(source(spark, sf)), list(out), digits)
    SQL[name] = bars_sql(text, stages, out, digits, more)


add("calendar_parts", c.parts, [], {"day_of_week": "#isodow(ts) - 1", "day_of_month": "#day(ts)", "month": "#month(ts)", "quarter": "#quarter(ts)", "year": "#year(ts)", "week_of_year": "#weekofyear(ts)"})
add("calendar_cycles", c.cyclical, [], {f"{n}_{f}": f"{f}({e} * (2 * pi() / {p}))" for n, e, p in (("day", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12), ("dom", "day(ts)", 31)) for f in ("sin", "cos")})
FOMC = "month(ts) IN (1, 3, 5, 6, 7, 9, 11, 12)"
flag = lambda e: f"#CASE WHEN {e} THEN 1 ELSE 0 END"
add("calendar_effects", c.effects, [{"ld": "max(day(ts)) OVER (PARTITION BY symbol, year(ts), month(ts))"}], {"fomc_month": flag(FOMC), "likely_fomc_week": flag(f"{FOMC} AND day(ts) BETWEEN 15 AND 22"), "is_quarter_end": flag("month(ts) IN (3, 6, 9, 12) AND day(ts) >= 25"), "last_5_days_of_month": flag("day(ts) > ld - 5"), "first_3_days_of_month": flag("day(ts) <= 3"), "month_end_window": flag("day(ts) > ld - 5 OR day(ts) <= 3"), "december_tax_effect": flag("month(ts) = 12 AND day(ts) >= 15"), "january_effect": flag("month(ts) = 1 AND day(ts) <= 15"), "summer_months": flag("month(ts) IN (6, 7, 8)"), "winter_months": flag("month(ts) IN (12, 1, 2)")})
add("intraday", c.intraday, [{"t": "hour(ts) + minute(ts) / 60.0"}], {"hour": "#hour(ts)", "minute": "#minute(ts)", "time_of_day": "t::DOUBLE", "time_sin": "sin(2 * pi() * t / 24)", "time_cos": "cos(2 * pi() * t / 24)", "market_open_30min": flag("t >= 9 AND t < 9.5"), "market_close_30min": flag("t >= 15.5 AND t < 16"), "lunch_hour": flag("t >= 12 AND t < 13"), "u_shape_pattern": "1 - least(abs(t - 9) / 3.5, abs(t - 16) / 3.5)::DOUBLE"}, bars="event")
add("volume_percentile", c.volume_percentile, [{"rk": "rank() OVER (PARTITION BY symbol, hour(ts) ORDER BY volume)", "ti": "count(*) OVER (PARTITION BY symbol, hour(ts), volume)", "n": "count(*) OVER (PARTITION BY symbol, hour(ts))"}], {"volume_percentile": "(rk + (ti - 1) / 2.0) / n"}, bars="event")
obs = lambda m, d: f"(SELECT x + CASE isodow(x) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END FROM (SELECT make_date(y, {m}, {d}) AS x))"
nth = lambda m, wd, n: f"(make_date(y, {m}, 1) + ((({wd} - (isodow(make_date(y, {m}, 1)) - 1)) % 7 + 7) % 7 + {7 * (n - 1)})::INT)"
DAYS = [obs(1, 1), nth(1, 0, 3), nth(2, 0, 3), "(make_date(y, 5, 31) - (isodow(make_date(y, 5, 31)) - 1)::INT)", f"CASE WHEN y >= 2021 THEN {obs(6, 19)} END", obs(7, 4), nth(9, 0, 1), nth(10, 0, 2), obs(11, 11), nth(11, 3, 4), obs(12, 25)]
HOL = "hol AS (SELECT unnest([" + ", ".join(DAYS) + "])::DATE AS h FROM (SELECT unnest(range(1990, 2031))::INT AS y))"
add("holidays", c.holidays, [], {"is_holiday": flag("ts::DATE IN (SELECT h FROM hol WHERE h IS NOT NULL)"), "is_day_before_holiday": flag("ts::DATE + 1 IN (SELECT h FROM hol WHERE h IS NOT NULL)"), "is_day_after_holiday": flag("ts::DATE - 1 IN (SELECT h FROM hol WHERE h IS NOT NULL)")}, more=HOL)

J1 = {"m": "(SELECT close FROM s0 WHERE s0.ts = b0.ts)"}
J2 = {"ref_close": f"last_value(m IGNORE NULLS) {SO_FAR}"}
J3 = {"rt": f"close / nullif({lag('close')}, 0) - 1", "rr": f"ref_close / nullif({lag('ref_close')}, 0) - 1"}
J4 = {"ok": "CASE WHEN rt IS NOT NULL AND rr IS NOT NULL THEN 1 END"}


def cross(name, make, stages, out, digits=6):
    Q[name] = lambda spark, sf: rounded(make(x.align(order_bars(spark, sf), ship_bars(spark, sf))), list(out), digits)
    SQL[name] = bars_sql(ORDER_BARS, [J1, J2, J3, J4, *stages], out, digits, SHIP_BARS)


W3 = (5, 20, 60)
cross("rel_strength", x.relative, [{f"k{w}": f"CASE WHEN count(ok) {last(w)} = {w} THEN product(1 + rt) {last(w)} / nullif(product(1 + rr) {last(w)}, 0) END" for w in W3}, {f"{a}{w}": f"{f}(k{w}) {last(w)}" for w in W3 for a, f in (("lo", "min"), ("hi", "max"), ("n", "count"))}], {"ref_close": "ref_close", "price_ratio": "close / nullif(ref_close, 0)", "relative_return": "rt - rr"} | {f"rel_strength_{w}": f"k{w}" for w in W3} | {f"rel_strength_norm_{w}": f"CASE WHEN n{w} = {w} AND round(hi{w} - lo{w}, 12) > 0 THEN (k{w} - lo{w}) / (hi{w} - lo{w}) END" for w in W3}, digits=5)
W4 = (20, 60, 120)
cross("rolling_beta", lambda d: x.correlation_beta(x.relative(d)), [], {f"correlation_{w}": f"CASE WHEN count(ok) {last(w)} = {w} THEN covar_samp(rt, rr) {last(w)} / nullif(stddev_samp(rt) {last(w)} * stddev_samp(rr) {last(w)}, 0) END" for w in W4} | {f"beta_{w}": f"CASE WHEN count(ok) {last(w)} = {w} THEN regr_slope(rt, rr) {last(w)} END" for w in W4})
side = lambda s, e: f"CASE WHEN i > 60 AND count(CASE WHEN ok = 1 AND {e} THEN 1 END) {last(60, 1)} >= 10 THEN regr_slope(CASE WHEN ok = 1 AND {e} THEN rt END, CASE WHEN ok = 1 AND {e} THEN rr END) {last(60, 1)} END"
cross("conditional_beta", lambda d: x.conditional_beta(x.relative(d)), [{"v": f"round({roll('stddev_samp(rr)', 'rr', 60)}, 10)", "i": f"row_number() {SERIES}"}, {"md": f"round({roll('quantile_cont(v, 0.5)', 'v', 60)}, 10)"}, {"hv": "coalesce(v > md, false)"}], {"beta_highvol_60": side("high", "hv"), "beta_lowvol_60": side("low", "NOT hv")})
H1 = {"y": "CASE WHEN close > 0 THEN ln(close) END", "z": "CASE WHEN ref_close > 0 THEN ln(ref_close) END"}
F1 = last(120, 1)
H2 = {"full_": f"count(CASE WHEN y IS NOT NULL AND z IS NOT NULL THEN 1 END) {F1} = 120", "be": f"regr_slope(y, z) {F1}", "al": f"regr_intercept(y, z) {F1}", "r2": f"regr_r2(y, z) {F1}", "vy": f"var_pop(y) {F1}", "ly": lag("y"), "lz": lag("z")}
cross("hedge_ratio", x.hedge, [H1, H2], {"hedge_ratio": "CASE WHEN full_ THEN be END", "spread_zscore": "CASE WHEN full_ THEN (ly - (al + be * lz)) / nullif(sqrt(greatest((1 - r2) * vy, 0)), 0) END"}, digits=5)
Q["cointegration"] = lambda spark, sf: rounded(u.cointegration(x.align(order_bars(spark, sf), ship_bars(spark, sf)), block=500), ["coint_stat", "coint_pvalue"], 4)
# The window's rows one by one: spread, its changes, then sums of both regressions.
_LISTS = bars_sql(ORDER_BARS, [J1, J2, H1, {"full_": H2["full_"], "be": H2["be"]}], {"be": "=CASE WHEN full_ THEN be END", "ys": f"=list(y) {F1}", "zs": f"=list(z) {F1}"}, more=SHIP_BARS)
_SUMS = ", ".join(f"{f} FILTER (i >= {k}) * {121 - k} AS {n}" for k, n, f in ((2, "a", "covar_pop(d, el)"), (2, "b", "var_pop(el)"), (2, "c", "var_pop(d)"), (3, "ud", "covar_pop(d, el)"), (3, "uu", "var_pop(el)"), (3, "dd", "var_pop(d)"), (3, "ww", "var_pop(dl)"), (3, "uw", "covar_pop(dl, el)"), (3, "wd", "covar_pop(dl, d)")))
COINT = f"""WITH w AS ({_LISTS}), e AS (SELECT symbol, ts, i, y - be * z AS e FROM (SELECT symbol, ts, be, unnest(ys) AS y, unnest(zs) AS z, unnest(range(1, 121)) AS i FROM w WHERE be IS NOT NULL)),
f AS (SELECT symbol, ts, i, e - lag(e) OVER v AS d, lag(e) OVER v AS el, lag(e) OVER v - lag(e, 2) OVER v AS dl FROM e WINDOW v AS (PARTITION BY symbol, ts ORDER BY i)),
g AS (SELECT symbol, ts, {_SUMS} FROM f GROUP BY symbol, ts),
h AS (SELECT *, dd - ud * ud / uu AS s0, dd - (ud * ww - wd * uw) / (uu * ww - uw * uw) * ud - (wd * uu - ud * uw) / (uu * ww - uw * uw) * wd AS s1 FROM g),
t AS (SELECT symbol, ts, CASE WHEN 118 * ln(s1) + 2 < 118 * ln(s0) THEN (ud * ww - wd * uw) / (uu * ww - uw * uw) / sqrt(s1 / 115 * ww / (uu * ww - uw * uw)) ELSE a / b / sqrt((c - a * a / b) / 117 / b) END AS st FROM h)
SELECT w.symbol, w.ts, round(st, 4) AS coint_stat, round({adf_p_sql('st')}, 4) AS coint_pvalue FROM w LEFT JOIN t USING (symbol, ts)"""
SQL["cointegration"] = COINT
M1 = {"i": f"row_number() {SERIES} - 1", "dy": "least(greatest((year(ts) - 2000) * 2 + 230, 230), 252)", "n": "count(*) OVER (PARTITION BY symbol)"}
M2 = {"ir": "sin(2 * pi() * i / dy / 5) * 2 + 3", "yc": "sin(2 * pi() * i / dy / 3)"}
M3 = {"bk": f"round(coalesce({lag('ir', 10)}, (SELECT q.ir FROM b2 q WHERE q.symbol = b2.symbol AND q.i = b2.i + b2.n - 10)), 10)"}
add("macro_proxies", x.macro_proxies, [M1, M2, M3], {"interest_rate_proxy": "ir", "yield_curve_slope_proxy": "yc", "tightening_cycle": "#(round(ir, 10) > bk)::INT", "easing_cycle": "#(round(ir, 10) < bk)::INT"})
K1 = {"r": f"close / nullif({lag('close')}, 0) - 1", "i": f"row_number() {SERIES} - 1"}
K2 = {"v": f"sqrt(252) * {roll('stddev_samp(r)', 'r', 20)}", "a": roll("avg(close)", "close", 100), "b": roll("avg(close)", "close", 200)}
K3 = {"cm": roll("avg(v)", "v", 100)}
add("market_flags", x.market_flags, [K1, K2, K3], {"bull_market_proxy": "#coalesce(round(a - b, 6) > 0, false)::INT", "high_vol_regime": "#coalesce(round(v - cm, 10) > 0, false)::INT", "high_correlation_regime": "#(round(power(sin(2 * pi() * i / 500), 2), 10) > 0.7)::INT"})

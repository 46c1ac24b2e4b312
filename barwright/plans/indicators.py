"""Queries of technical indicators."""

from __future__ import annotations

from ..functions.windows import rounded, sma as mean
from ..operators import indicators as t
from ..sources.bars import event_bars, order_bars
from .sqltext import EVENT_BARS, ORDER_BARS, SERIES, SO_FAR, bars_sql, lag, last, roll, sma

Q, SQL = {}, {}


def add(name, make, stages, out, digits=6, bars="order"):
    source, text = (order_bars, ORDER_BARS) if bars == "order" else (event_bars, EVENT_BARS)
    Q[name] = lambda spark, sf: rounded(make(source(spark, sf)), list(out), digits)
    SQL[name] = bars_sql(text, stages, out, digits)


hi, lo = (lambda n: roll("max(high)", "close", n)), (lambda n: roll("min(low)", "close", n))
full = lambda e, n: roll(e, "close", n)
TR = f"CASE WHEN {lag('close')} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END"
TYP = "(high + low + close) / 3"

add("prices", t.prices, [], {"wcprice": "(high + low + 2 * close) / 4", "typprice": TYP, "tr": TR, "marketfi": "(high - low) / nullif(volume, 0)"}, bars="event")
add("bollinger", t.bollinger, [{"m": sma("close", 20), "sd": full("stddev_pop(close)", 20)}], {"bbm": "m", "bbh": "m + 2 * sd", "bbl": "m - 2 * sd", "bbw": "4 * sd / nullif(m, 0) * 100", "bbp": "CASE WHEN round(sd, 9) > 0 THEN (close - (m - 2 * sd)) / (4 * sd) END", "bbhi": "#CASE WHEN m IS NOT NULL THEN (round(close - (m + 2 * sd), 9) > 0)::INT END", "bbli": "#CASE WHEN m IS NOT NULL THEN (round((m - 2 * sd) - close, 9) > 0)::INT END"}, digits=4)
add("donchian", t.donchian, [{"h": hi(20), "l": lo(20), "m": sma("close", 20)}], {"dch": "h", "dcl": "l", "dcm": "(h + l) / 2", "dcw": "(h - l) / nullif(m, 0) * 100", "dcp": "(close - l) / nullif(h - l, 0)"}, bars="event")
add("keltner", t.keltner, [{"m": full(f"avg({TYP})", 10), "r": full("avg(high - low)", 10)}], {"kcc": "m", "kch": "m + r", "kcl": "m - r", "kcw": "2 * r / nullif(m, 0) * 100", "kcp": "(close - (m - r)) / nullif(2 * r, 0)", "kchi": "#round(close - (m + r), 9) > 0", "kcli": "#round((m - r) - close, 9) > 0"}, digits=4)
add("stochastic", t.stochastic, [{"h": hi(14), "l": lo(14)}, {"k": "(close - l) / nullif(h - l, 0) * 100"}], {"stoch": "k", "stoch_signal": roll("avg(k)", "k", 3), "willr": "(h - close) / nullif(h - l, 0) * -100"})
add("cci", t.cci, [{"t": TYP}, {"m": sma("t", 20), "a": f"list(t) {last(20)}"}, {"mad": "list_sum(list_transform(a, lambda x: abs(x - m))) / 20"}], {"cci": "CASE WHEN round(mad, 9) > 0 THEN (t - m) / (0.015 * mad) END"}, digits=4)
add("aroon", t.aroon, [{"i": f"row_number() {SERIES}"}, {"u": full("arg_max(i, {'x': high, 'i': i})", 26), "d": full("arg_min(i, {'x': low, 'i': -i})", 26)}], {"aroon_up": "100 * (25 - (i - u)) / 25.0", "aroon_down": "100 * (25 - (i - d)) / 25.0", "aroon_ind": "100 * (25 - (i - u)) / 25.0 - 100 * (25 - (i - d)) / 25.0"})
add("vortex", t.vortex, [{"tr": TR, "p": f"abs(high - {lag('low')})", "m": f"abs(low - {lag('high')})"}, {"st": roll("sum(tr)", "tr", 14), "sp": roll("sum(p)", "p", 14), "sm": roll("sum(m)", "m", 14)}], {"vortex_pos": "sp / nullif(st, 0)", "vortex_neg": "sm / nullif(st, 0)", "vortex_diff": "sp / nullif(st, 0) - sm / nullif(st, 0)"}, digits=5)
add("ichimoku", t.ichimoku, [{"c": f"({hi(9)} + {lo(9)}) / 2", "s": f"({hi(26)} + {lo(26)}) / 2", "sb": f"({hi(52)} + {lo(52)}) / 2"}, {"a": "(c + s) / 2"}], {"ichimoku_conv": "c", "ichimoku_base": "s", "ichimoku_a": "a", "ichimoku_b": "sb", "visual_ichimoku_a": lag("a", 26), "visual_ichimoku_b": lag("sb", 26)}, digits=4)
add("kst", t.kst, [{f"r{i}": f"(close - {lag('close', p)}) / nullif({lag('close', p)}, 0)" for i, p in enumerate((10, 15, 20, 30))}, {"k": "100 * (" + " + ".join(f"{w} * {roll(f'avg(r{i})', f'r{i}', n)}" for i, (n, w) in enumerate(((10, 1), (10, 2), (10, 3), (15, 4)))) + ")"}, {"g": roll("avg(k)", "k", 9)}], {"kst": "k", "kst_sig": "g", "kst_diff": "k - g"}, digits=4)
MF = {"t": TYP, "clv": "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0)", "d": f"close - {lag('close')}"}
MF2 = {"u": f"CASE WHEN t > {lag('t')} THEN t * volume ELSE 0 END", "w": f"CASE WHEN t < {lag('t')} THEN t * volume ELSE 0 END", "em": f"((high + low) / 2 - ({lag('high')} + {lag('low')}) / 2) * (high - low) / nullif(volume, 0)", "r": f"d / nullif({lag('close')}, 0)"}
MF3 = {"su": full("sum(u)", 14), "sw": full("sum(w)", 14)}
MFO = {"mfi": "CASE WHEN su IS NULL THEN NULL WHEN sw = 0 THEN 100 ELSE 100 - 100 / (1 + su / nullif(sw, 0)) END", "cmf": f"{full('sum(clv * volume)', 14)} / nullif({full('sum(volume)', 14)}, 0)", "adi": f"sum(clv * volume) {SO_FAR}", "obv": f"sum(CASE WHEN d > 0 THEN volume WHEN d < 0 THEN -volume ELSE 0 END) {SO_FAR}", "vpt": f"sum(coalesce(r * volume, 0)) {SO_FAR}", "vwap": f"{full('sum(t * volume)', 14)} / nullif({full('sum(volume)', 14)}, 0)", "vwma": f"{full('sum(close * volume)', 14)} / nullif({full('sum(volume)', 14)}, 0)", "em": "em", "sma_em": roll("avg(em)", "em", 14), "force": "d * volume"}
TOTALS = ("adi", "obv", "vpt")
add("money_flow", t.money_flow, [MF, MF2, MF3], {k: e for k, e in MFO.items() if k not in TOTALS}, digits=9, bars="event")
add("money_flow_totals", t.money_flow, [MF, MF2, MF3], {k: MFO[k] for k in TOTALS}, digits=3, bars="event")
add("volume_index", t.volume_index, [{"r": f"coalesce(close / nullif({lag('close')}, 0), 1)"}, {"n": f"CASE WHEN volume < {lag('volume')} THEN r ELSE 1 END", "p": f"CASE WHEN volume > {lag('volume')} THEN r ELSE 1 END", "w": f"CASE WHEN close > {lag('close')} THEN close - least(low, {lag('close')}) WHEN close < {lag('close')} THEN close - greatest(high, {lag('close')}) ELSE 0 END"}], {"nvi": f"1000 * product(n) {SO_FAR}", "pvi": f"1000 * product(p) {SO_FAR}", "wad": f"sum(w) {SO_FAR}"}, digits=3)
wma = lambda x, n: f"CASE WHEN count({x}) {last(n)} = {n} THEN (" + " + ".join(f"{n - i} * {lag(x, i) if i else x}" for i in range(n)) + f") / {n * (n + 1) / 2} END"
add("hull", t.hull, [{"w": wma("close", 16)}, {"x": f"2 * {wma('close', 8)} - w"}], {"wma": "w", "hma": wma("x", 4)}, digits=5)
add("linear_regression", t.linear_regression, [{"i": f"(row_number() {SERIES})::DOUBLE"}, {"s": full("regr_slope(close, i)", 14), "m": sma("close", 14)}, {"e": "m + s * 6.5"}], {"linregslope": "s", "linregintercept": "m - s * 6.5", "linreg": "e", "fosc": f"100 * (close - ({lag('e')} + {lag('s')})) / nullif(close, 0)"}, digits=3)
OS = {"a": f"abs(close - {lag('close')})", "md": "(high + low) / 2", "bp": f"CASE WHEN {lag('close')} IS NULL THEN close - low ELSE close - least(low, {lag('close')}) END", "tr": TR, "q": "close - open", "dd": f"100 * (close - max(close) {last(14)}) / nullif(max(close) {last(14)}, 0)"}
sh = lambda k: f"{roll('sum(bp)', 'bp', k)} / nullif({roll('sum(tr)', 'tr', k)}, 0)"
add("oscillators", t.oscillators, [OS], {"roc": f"(close - {lag('close', 14)}) / nullif({lag('close', 14)}, 0) * 100", "dpo": f"{lag('close', 8)} - {sma('close', 14)}", "ao": f"{sma('md', 5)} - {sma('md', 34)}", "qstick": sma("q", 14), "vhf": f"({full('max(close)', 14)} - {full('min(close)', 14)}) / nullif({roll('sum(a)', 'a', 14)}, 0)", "ui": f"sqrt({full('avg(dd * dd)', 14)})", "uo": f"100 * (4 * {sh(7)} + 2 * {sh(14)} + {sh(28)}) / 7", "vosc": f"({sma('volume', 5)} - {sma('volume', 14)}) / nullif({sma('volume', 14)}, 0) * 100", "others_cr": f"close / nullif(first(close) {SO_FAR}, 0) * 100 - 100", "others_dr": f"close / nullif({lag('close')}, 0) * 100 - 100"}, digits=4)
CB = {"b": "abs(close - open)", "u": "high - greatest(open, close)", "d": "least(open, close) - low", "r": "high - low", "g": "(close > open)::INT - (close < open)::INT"}
CB2 = {"ab": f"avg(b) {last(10, 1)}", "ar": f"avg(r) {last(10, 1)}", "o1": lag("open"), "c1": lag("close"), "b1": lag("b"), "g1": lag("g"), "o2": lag("open", 2), "c2": lag("close", 2), "b2": lag("b", 2), "g2": lag("g", 2), "c3": lag("close", 3)}
CB3 = {"ab1": lag("ab"), "hammer": "b < 0.5 * ab AND d > 2 * b AND u < 0.1 * ar", "top": "b < 0.5 * ab AND u > 2 * b AND d < 0.1 * ar"}
CB4 = {"inside": "b1 > ab1 AND greatest(open, close) < greatest(o1, c1) AND least(open, close) > least(o1, c1)"}
fl = lambda c, v=100: f"#CASE WHEN {c} THEN {v} ELSE 0 END"
add("candles", t.candles, [CB, CB2, CB3, CB4], {"cdl_doji": fl("b <= 0.1 * ar"), "cdl_hammer": fl("hammer AND close < c3"), "cdl_hanging_man": fl("hammer AND close > c3", -100), "cdl_shooting_star": fl("top AND close > c3", -100), "cdl_engulfing": "#CASE WHEN g = 1 AND g1 = -1 AND close >= o1 AND open <= c1 THEN 100 WHEN g = -1 AND g1 = 1 AND open >= c1 AND close <= o1 THEN -100 ELSE 0 END", "cdl_harami": "#CASE WHEN inside AND g1 = -1 THEN 100 WHEN inside AND g1 = 1 THEN -100 ELSE 0 END", "cdl_marubozu": fl("b > ab AND u < 0.05 * ar AND d < 0.05 * ar", "100 * g"), "cdl_morning_star": fl("g2 = -1 AND b1 < 0.5 * b2 AND g = 1 AND close > (o2 + c2) / 2"), "cdl_evening_star": fl("g2 = 1 AND b1 < 0.5 * b2 AND g = -1 AND close < (o2 + c2) / 2", -100)})
band = lambda x, a, z: f"CASE WHEN round({x}, 9) > {z} THEN -1.0 WHEN round({x}, 9) < {a} THEN 1.0 ELSE 0.0 END"
CN = [{"s20": sma("close", 20), "s50": sma("close", 50), "h": hi(14), "l": lo(14)} | MF, {"k": "(close - l) / nullif(h - l, 0) * 100", "m20": sma("t", 20), "ta": f"list(t) {last(20)}"} | MF2, {"mad": "list_sum(list_transform(ta, lambda x: abs(x - m20))) / 20", "cm": f"{full('sum(clv * volume)', 14)} / nullif({full('sum(volume)', 14)}, 0)"} | MF3, {"cc": "CASE WHEN round(mad, 9) > 0 THEN (t - m20) / (0.015 * mad) END", "mf": "CASE WHEN su IS NULL THEN NULL WHEN sw = 0 THEN 100 ELSE 100 - 100 / (1 + su / nullif(sw, 0)) END"}]
CN.append({"tc": "(coalesce(sign(round(close - s20, 9)), 0) + coalesce(sign(round(close - s50, 9)), 0)) / 2.0", "oc": f"({band('k', 20, 80)} + {band('cc', -100, 100)}) / 2", "vc": f"({band('mf', 20, 80)} + coalesce(sign(round(cm, 9)), 0)) / 2"})


def _consensus(df):
    return t.consensus(t.money_flow(t.cci(t.stochastic(df.withColumns({"sma_20": mean("close", 20), "sma_50": mean("close", 50)})))))


add("consensus", _consensus, CN, {"trend_consensus": "tc", "oscillator_consensus": "oc", "volume_consensus": "vc", "market_consensus": "0.5 * tc + 0.3 * oc + 0.2 * vc"})

"""Queries of smoothed indicators, indicators by timeframe and votes by column name."""

from __future__ import annotations

from ..functions.windows import rounded
from ..operators import blocks as bk
from ..operators import momentum as mo
from ..sources.bars import event_bars, order_bars
from .indicators import MF, MF2, TYP, full, hi, lo
from .sqltext import EVENT_BARS, ORDER_BARS, SO_FAR, bars_sql, lag, last, roll, sma

Q, SQL = {}, {}
BLOCK = 500


def add(name, make, stages, out, digits=6, bars="order"):
    source, text = (order_bars, ORDER_BARS) if bars == "order" else (event_bars, EVENT_BARS)
    Q[name] = lambda spark, sf: rounded(make(source(spark, sf)), list(out), digits)
    SQL[name] = bars_sql(text, stages, out, digits)


def known(x: str) -> str:
    """All known values up to the row."""
    return f"(list({x}) FILTER ({x} IS NOT NULL) {SO_FAR})"


def mean(x: str, a: float) -> str:
    """Exponential mean that starts with the first known value."""
    return f"CASE WHEN {x} IS NOT NULL THEN list_reduce({known(x)}, lambda p, q: p + {a!r}::DOUBLE * (q - p)) END"


def wilder(x: str, n: int) -> str:
    """The mean of the first n known values, later ones smoothed."""
    v = known(x)
    return f"CASE WHEN count({x}) {SO_FAR} >= {n} THEN list_reduce(list_prepend(list_avg({v}[1:{n}]), {v}[{n + 1}:]), lambda p, q: (p * {n - 1} + q) / {n}) END"


def place(x: str, n: int) -> str:
    low, high = roll(f"min({x})", x, n), roll(f"max({x})", x, n)
    return f"CASE WHEN round({high} - {low}, 6) > 0 THEN 100 * ({x} - {low}) / nullif({high} - {low}, 0) END"


def _smoothed(d):
    return mo.range_change(mo.volume_oscillator(mo.smoothed_force(d, block=BLOCK), block=BLOCK), block=BLOCK)


add(
    "smoothed_volume",
    _smoothed,
    [
        {"f": f"(close - {lag('close')}) * volume", "r": "high - low"},
        {"fe": mean("f", 2 / 14), "a": mean("volume", 2 / 13), "b": mean("volume", 2 / 27), "e": mean("r", 2 / 11)},
        {"o": "100 * (a - b) / nullif(b, 0)"},
        {"g": mean("o", 2 / 10)},
    ],
    {"force_ema": "fe", "pvo": "o", "pvo_signal": "g", "pvo_hist": "o - g", "cvi": f"100 * (e - {lag('e', 10)}) / nullif({lag('e', 10)}, 0)"},
    4,
)
add(
    "trend_cycle",
    lambda d: mo.trend_cycle(d, block=BLOCK),
    [{"m": f"{mean('close', 2 / 24)} - {mean('close', 2 / 51)}"}, {"k": place("m", 10)}, {"d": mean("k", 0.5)}, {"p": place("d", 10)}],
    {"stc": mean("p", 0.5)},
    3,
)
CHANGE = {"gain": f"greatest(close - {lag('close')}, 0)", "fall": f"greatest({lag('close')} - close, 0)", "late": f"{lag('close')} IS NOT NULL"}
# greatest ignores nulls, so the first row's changes are taken out.
CHANGES = {"gn": "CASE WHEN late THEN gain END", "ls": "CASE WHEN late THEN fall END"}
RSI = "CASE WHEN {l} = 0 THEN 100 ELSE 100 - 100 / (1 + {g} / nullif({l}, 0)) END"
add(
    "stochastic_rsi",
    lambda d: mo.stochastic_rsi(bk.wilder_indicators(d, block=BLOCK)),
    [CHANGE, CHANGES, {"ga": wilder("gn", 14), "la": wilder("ls", 14)}, {"rsi": f"CASE WHEN ga IS NOT NULL THEN {RSI.format(g='ga', l='la')} END"}, {"s": f"{place('rsi', 14)} / 100"}, {"k": sma("s", 3)}],
    {"stoch_rsi": "s", "stoch_rsi_k": "k", "stoch_rsi_d": sma("k", 3)},
    4,
)
PAST = f"(list(close) {last(5)})"
WAVE = lambda f: "CASE WHEN len(v) = 5 THEN " + " + ".join(f"{f}(2 * pi() * {i} / 5) * v[{5 - i}]" for i in range(5)) + " END"
PHASE = "CASE WHEN abs(re) > 0.001 THEN atan2(im, re) WHEN re IS NOT NULL THEN CASE WHEN im < 0 THEN -pi() / 2 ELSE pi() / 2 END END + pi() / 2"
add("sine_wave", mo.sine_wave, [{"v": PAST}, {"re": WAVE("cos"), "im": WAVE("sin")}, {"p": PHASE}], {"msw_sine": "sin(p)", "msw_lead": "sin(p + pi() / 4)"}, 5, bars="event")

# Several timeframes in one frame, votes over what it holds, and standard scores.
TIMES = (10, 30)
FAMILIES = ("sma", "ema", "wilder", "stochastic", "cci", "money_flow")
SHOWN = ("sma", "ema", "adx", "rsi", "stoch", "stoch_signal", "willr", "cci", "mfi", "cmf")
TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
DIRECTION = {
    "rng": f"CASE WHEN {lag('close')} IS NOT NULL THEN {TR} END",
    "up": f"high - {lag('high')}", "dn": f"{lag('low')} - low",
}
DIRECTIONS = {"pl": "CASE WHEN late THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END END", "mi": "CASE WHEN late THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END END"}
FRAME = [CHANGE | DIRECTION | MF, CHANGES | DIRECTIONS | MF2, {}, {}, {}, {}]
for _n in TIMES:
    FRAME[2] |= {f"sma_{_n}": sma("close", _n), f"ema_{_n}": mean("close", 2 / (_n + 1)), f"ga{_n}": wilder("gn", _n), f"la{_n}": wilder("ls", _n), f"at{_n}": wilder("rng", _n), f"pa{_n}": wilder("pl", _n), f"ma{_n}": wilder("mi", _n)}
    FRAME[2] |= {f"h{_n}": hi(_n), f"l{_n}": lo(_n), f"mt{_n}": sma("t", _n), f"lt{_n}": f"list(t) {last(_n)}", f"su{_n}": full("sum(u)", _n), f"sw{_n}": full("sum(w)", _n), f"cmf_{_n}": f"{full('sum(clv * volume)', _n)} / nullif({full('sum(volume)', _n)}, 0)"}
    FRAME[3] |= {f"rsi_{_n}": f"CASE WHEN ga{_n} IS NOT NULL THEN {RSI.format(g=f'ga{_n}', l=f'la{_n}')} END", f"pd{_n}": f"100 * pa{_n} / nullif(at{_n}, 0)", f"md{_n}": f"100 * ma{_n} / nullif(at{_n}, 0)"}
    FRAME[3] |= {f"stoch_{_n}": f"(close - l{_n}) / nullif(h{_n} - l{_n}, 0) * 100", f"willr_{_n}": f"(h{_n} - close) / nullif(h{_n} - l{_n}, 0) * -100", f"mad{_n}": f"list_sum(list_transform(lt{_n}, lambda x: abs(x - mt{_n}))) / {_n}"}
    FRAME[3] |= {f"mfi_{_n}": f"CASE WHEN su{_n} IS NULL THEN NULL WHEN sw{_n} = 0 THEN 100 ELSE 100 - 100 / (1 + su{_n} / nullif(sw{_n}, 0)) END"}
    FRAME[4] |= {f"dx{_n}": f"100 * abs(pd{_n} - md{_n}) / nullif(pd{_n} + md{_n}, 0)", f"stoch_signal_{_n}": roll(f"avg(stoch_{_n})", f"stoch_{_n}", 3), f"cci_{_n}": f"CASE WHEN round(mad{_n}, 9) > 0 THEN (t - mt{_n}) / (0.015 * mad{_n}) END"}
    FRAME[5] |= {f"adx_{_n}": wilder(f"dx{_n}", _n)}
NAMES = [f"{c}_{n}" for n in TIMES for c in SHOWN]


def _frame(d):
    d = mo.by_timeframe(d, TIMES, FAMILIES)
    return d.select("symbol", "ts", "close", *NAMES)


add("timeframe_indicators", _frame, FRAME, {c: c for c in NAMES}, 3)
SIGN = lambda e: f"coalesce(sign(round({e}, 9)), 0)"
BAND = lambda x, a, z: f"CASE WHEN round({x}, 9) > {z} THEN -1.0::DOUBLE WHEN round({x}, 9) < {a} THEN 1.0 ELSE 0.0 END"
VOTES = {"tc": [], "oc": [], "vc": []}
for _n in TIMES:
    VOTES["tc"] += [SIGN(f"close - sma_{_n}"), SIGN(f"close - ema_{_n}"), f"CASE WHEN round(adx_{_n}, 9) > 25 THEN 1.0::DOUBLE ELSE 0 END"]
    VOTES["oc"] += [BAND(f"rsi_{_n}", 30, 70), BAND(f"stoch_{_n}", 20, 80), BAND(f"stoch_signal_{_n}", 20, 80), BAND(f"cci_{_n}", -100, 100)]
    VOTES["vc"] += [BAND(f"mfi_{_n}", 20, 80), SIGN(f"cmf_{_n}")]
VOTED = {k: f"greatest(-1, least(1, ({' + '.join(v)}) / {len(v)}.0::DOUBLE))" for k, v in VOTES.items()}
add(
    "consensus_by_name",
    lambda d: mo.consensus_by_name(_frame(d)),
    [*FRAME, VOTED],
    {"trend_consensus": "tc", "oscillator_consensus": "oc", "volume_consensus": "vc", "market_consensus": "0.5 * tc + 0.3 * oc + 0.2 * vc"},
)
SCORED = [c for c in NAMES if c.startswith(mo.SCORED)]
MOMENTS = {f"m_{c}": sma(c, 100) for c in SCORED} | {f"sd_{c}": f"round({roll(f'stddev_samp({c})', c, 100)}, 9)" for c in SCORED}
add(
    "standardized_by_name",
    lambda d: mo.standardized_by_name(_frame(d)),
    [*FRAME, MOMENTS],
    {f"zscore_{c}": f"CASE WHEN sd_{c} = 0 THEN 0 ELSE ({c} - m_{c}) / nullif(sd_{c}, 0) END" for c in SCORED},
    4,
)

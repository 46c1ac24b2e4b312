"""Queries of selection, assembled features and the rest of validation. Their SQL is put together from that of the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import rounded
from ..operators import assembly as a
from ..operators import crossasset as x
from ..operators import figures as fg
from ..operators import loss as lo
from ..operators import metrics as m
from ..operators import blocks as bk
from ..operators import selection as sel
from ..operators import validation as v
from ..sources.bars import event_bars, order_bars, quantity_bars, ship_bars
from ..sources.samples import samples
from . import context, indicators, models, validation, volatility
from .models import FEATURES, TM, named
from .sqltext import EVENT_BARS, ORDER_BARS, SERIES, last
from .validation import CPCV, FOLD, GRID, MC, ROLE, SAMPLES, STRAT, forecast_sql, risk_sql, score_sql, tidy

Q, SQL = {}, {}
PART = {**volatility.SQL, **context.SQL, **validation.SQL, **models.SQL}


def add(name, make, sql=None, digits=6, ctes=""):
    Q[name] = lambda spark, sf: tidy(make(samples(spark, sf)), digits)
    if sql:
        SQL[name] = f"WITH {SAMPLES}{ctes} {sql}"


def listed(names, made):
    return f"unnest([{', '.join(repr(n) for n in names)}]) AS feature, unnest([{', '.join(made)}])"


# Selection
USED = [*FEATURES, "sparse"]
RATIO = [f"avg(({'CASE WHEN row_id % 5 >= 2 THEN y END' if c == 'sparse' else c} IS NULL)::INT)" for c in USED]
add(
    "null_ratios",
    lambda d: sel.null_ratios(d.withColumn("sparse", F.when(F.col("row_id") % 5 >= 2, F.col("y"))), USED),
    f"SELECT feature, round(r, 6) AS null_ratio, r < 0.3 AS kept FROM (SELECT {listed(USED, RATIO)} AS r FROM s)",
)
PAIRS = [(p, q) for p in FEATURES for q in FEATURES]
add(
    "correlation_matrix",
    lambda d: sel.correlation_matrix(d, FEATURES),
    f"SELECT unnest([{', '.join(repr(p) for p, _ in PAIRS)}]) AS a, unnest([{', '.join(repr(q) for _, q in PAIRS)}]) AS b, "
    f"round(unnest([{', '.join(f'abs(corr({p}, {q}))' for p, q in PAIRS)}]), 6) AS correlation FROM s",
)
CORR = [f"abs(corr({f}, y))" for f in FEATURES]
add(
    "importance_table",
    lambda d: sel.importance_table(sel.importances(d, FEATURES, "y", ["mi", "correlation"]), ["mi", "correlation"]),
    "SELECT feature, round(mi, 4) AS mi_importance, round(c, 4) AS correlation_importance, round((mi + c) / 2, 4) AS average_importance "
    f"FROM ({PART['mutual_information']}) JOIN (SELECT {listed(FEATURES, CORR)} AS c FROM s) USING (feature)",
    4,
)
Q["select_features"] = lambda spark, sf: tidy(sel.select_features(samples(spark, sf), "y", ["mi", "correlation"], FEATURES, 3))
SQL["select_features"] = PART["feature_scores"]
add(
    "feature_stability",
    lambda d: sel.feature_stability(d, FEATURES, "y"),
    "SELECT feature, round(avg(i), 6) AS mean, round(stddev_pop(i), 6) AS std, round(min(i), 6) AS min, round(max(i), 6) AS max, "
    f"round(stddev_pop(i) / avg(i), 6) AS cv FROM (SELECT k, {listed(FEATURES, CORR)} AS i FROM s, range(5) t(k) "
    "WHERE (row_id * 48271 + k * 69621 + row_id * k * 16807) % 10007 < 8005 GROUP BY k) GROUP BY feature",
)
add("forest_folds", lambda d: sel.forest_importance(d, FEATURES, "y"))
add("lasso_folds", lambda d: sel.lasso_path(d, FEATURES, "y")[0])

# Regimes
W20 = "OVER (PARTITION BY symbol ORDER BY row_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
AHEAD = "OVER (PARTITION BY symbol ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
FULL = {"volatility": "stddev_samp(y)", "cum_return": "sum(y)", "skew": "skewness(y)"}
INPUTS = ", ".join(f"CASE WHEN count(y) {W20} = 20 THEN {e} {W20} END AS {n}" for n, e in FULL.items())
FIRST = ", ".join(f"first_value({n} IGNORE NULLS) {AHEAD} AS {n}" for n in FULL)
add(
    "regime_inputs",
    lambda d: a.regime_inputs(d).select("symbol", "row_id", *FULL, "sharpe"),
    f"SELECT symbol, row_id, {', '.join(f'round({n}, 5) AS {n}' for n in FULL)}, round(coalesce(cum_return / nullif(volatility, 0), 0), 5) AS sharpe "
    f"FROM (SELECT symbol, row_id, {FIRST} FROM (SELECT symbol, row_id, {INPUTS} FROM s))",
    5,
)
STATES = [1, 2, 3, 4]
PROBS = [f"trans_prob_{p}_to_{q}" for p in STATES for q in STATES]
STEP = [
    f"CASE WHEN regime = {p} THEN coalesce((SELECT prob FROM tm WHERE tm.symbol = s.symbol AND from_state = {p} AND to_state = {q}), 0) ELSE 0 END::DOUBLE AS trans_prob_{p}_to_{q}"
    for p in STATES for q in STATES
]
add(
    "regime_features",
    lambda d: a.regime_features(d, "regime", STATES).select("symbol", "row_id", *PROBS),
    f"SELECT symbol, row_id, {', '.join(STEP)} FROM s",
    ctes=f", tm AS ({TM})",
)
SEEN = "CASE WHEN row_id % 7 = 3 THEN {} END IGNORE NULLS"
BACK = "OVER (PARTITION BY symbol ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
NEAR = ", ".join(f"{f}({SEEN.format(c)}) {w} AS {f[0]}_{c}" for f, w in (("last_value", BACK), ("first_value", AHEAD)) for c in ("row_id", "regime"))
add(
    "nearest_fill",
    lambda d: a.nearest_fill(d.withColumn("label", F.when(F.col("row_id") % 7 == 3, F.col("regime"))), "label").select("symbol", "row_id", "label_filled"),
    "SELECT symbol, row_id, CASE WHEN f_row_id IS NULL OR row_id - l_row_id <= f_row_id - row_id THEN l_regime ELSE f_regime END::BIGINT AS label_filled "
    f"FROM (SELECT symbol, row_id, {NEAR} FROM s)",
)
add("clustering_regimes", lambda d: a.clustering_regimes(d).select("symbol", "row_id", "regime_cluster"))
add("transition_model", lambda d: a.transition_model(d.where("mom is not null"), ["vol", "mom"], rounds=20).select("symbol", "row_id", "changes", "change_probability"))

# The rest of validation
ROLES = ROLE.format(keep="ts < t0 - INTERVAL 5 DAY OR ts > t1 + INTERVAL 5 DAY")
add(
    "nested_folds",
    lambda d: v.nested_folds(v.purged_by_days(d)),
    "SELECT symbol, fold, row_id, f::BIGINT AS inner_fold, CASE WHEN least(i // (m // 3), 2) = f THEN 'test' ELSE 'train' END AS inner_role FROM "
    "(SELECT *, count(*) OVER (PARTITION BY symbol, fold) AS m, row_number() OVER (PARTITION BY symbol, fold ORDER BY row_id) - 1 AS i "
    f"FROM ({ROLES}) WHERE role = 'train'), range(3) t(f)",
    ctes=FOLD,
)
add(
    "n_splits",
    lambda d: v.n_splits(d, "walk"),
    "SELECT symbol, floor((max(n) - floor(round(max(n) * 0.5, 6))) / floor(round(max(n) * 0.1, 6)))::BIGINT AS n_splits FROM s GROUP BY symbol",
)
PB = "OVER (PARTITION BY symbol ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
WALK = (
    f", w1 AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS m, regr_slope(y, yhat) {PB} AS sl, regr_intercept(y, yhat) {PB} AS ic FROM s WHERE yhat IS NOT NULL), "
    "w2 AS (SELECT symbol, abs(y - ic - sl * yhat) AS e, row_number() OVER (PARTITION BY symbol ORDER BY row_id) - 1 AS st FROM w1 WHERE row_id >= floor(m * 0.3))"
)
add(
    "walk_forward_trend",
    v.walk_forward_trend,
    "SELECT symbol, count(*) AS steps, round(avg(e), 6) AS mean_error, round(regr_slope(e, st), 6) AS trend, round(regr_r2(e, st), 6) AS r2 FROM w2 GROUP BY symbol",
    ctes=WALK,
)
NUMBERS = "round(avg(rmse), 6) AS mean, round(stddev_pop(rmse), 6) AS std, round(min(rmse), 6) AS min, round(max(rmse), 6) AS max, round(quantile_cont(rmse, 0.05), 6) AS p5, round(quantile_cont(rmse, 0.95), 6) AS p95, count(*) AS n"
add("cpcv_summary", lambda d: v.score_summary(v.cpcv(d)), f"SELECT symbol, {NUMBERS} FROM sc GROUP BY symbol", ctes=score_sql(CPCV, "symbol, combo", ""))
DRAWN = score_sql("SELECT *, CASE WHEN picked THEN 'train' ELSE 'test' END AS role FROM mc WHERE picked OR free = 0 OR near = 0", "symbol, rep", "")
add("monte_carlo_summary", lambda d: v.score_summary(v.monte_carlo(d)), f"SELECT symbol, {NUMBERS} FROM sc GROUP BY symbol", ctes=MC + DRAWN)
LEAST = "{'r': round(rm, 10), 'p': purge, 'e': embargo}"
add(
    "best_purge",
    lambda d: v.best_purge(v.purge_grid(d)),
    f"SELECT symbol, arg_min(purge, {LEAST})::BIGINT AS purge, arg_min(embargo, {LEAST})::BIGINT AS embargo, round(arg_min(rm, {LEAST}), 6) AS rmse "
    "FROM (SELECT symbol, purge, embargo, avg(rmse) AS rm FROM sc GROUP BY ALL) GROUP BY symbol",
    ctes=FOLD + score_sql(GRID, "symbol, purge, embargo, tf", ""),
)
SPLIT = (
    FOLD + f", rl AS (SELECT q.*, s.y FROM ({ROLES}) q JOIN s USING (symbol, row_id)), "
    "vc AS (SELECT symbol, fold, y, count(*) FILTER (role = 'train') AS tr, count(*) FILTER (role = 'test') AS te FROM rl GROUP BY ALL), "
    "vs AS (SELECT symbol, fold, max(abs(ca - cb)) AS ks FROM (SELECT symbol, fold, sum(tr) OVER (PARTITION BY symbol, fold ORDER BY y) / sum(tr) OVER (PARTITION BY symbol, fold) AS ca, "
    "sum(te) OVER (PARTITION BY symbol, fold ORDER BY y) / sum(te) OVER (PARTITION BY symbol, fold) AS cb FROM vc) GROUP BY ALL), "
    "vd AS (SELECT symbol, fold, abs((avg(y) FILTER (role = 'test') - avg(y) FILTER (role = 'train')) / nullif(stddev_pop(y) FILTER (role = 'train'), 0)) AS drift FROM rl GROUP BY ALL), "
    "vb AS (SELECT symbol, fold, ks, round(ks + 0.1 * coalesce(drift, 0), 10) AS score FROM vs JOIN vd USING (symbol, fold))"
)
SMALL = "{'s': score, 'f': fold}"
add(
    "best_split",
    lambda d: v.best_split(v.purged_by_days(d)),
    f"SELECT symbol, arg_min(fold, {SMALL})::BIGINT AS fold, round(arg_min(ks, {SMALL}), 6) AS ks, round(min(score), 6) AS score FROM vb GROUP BY symbol",
    ctes=SPLIT,
)


def section(name, sql, names):
    columns = ", ".join(f"({n})::DOUBLE" for n in names)
    return f"SELECT symbol, '{name}' AS section, unnest([{', '.join(repr(n) for n in names)}]) AS metric, unnest([{columns}]) AS value FROM ({sql})"


STATS = ["mean", "std", "min", "max", "p5", "p95", "n"]
DECAY = f"SELECT symbol, arg_max(rmse, quintile) AS last_rmse, any_value(trend) AS trend FROM ({PART['performance_decay']}) GROUP BY symbol"
Q["validate"] = lambda spark, sf: tidy(v.validate(samples(spark, sf)))
SQL["validate"] = " UNION ALL ".join(
    [
        section("purge", SQL["best_purge"], ["purge", "embargo", "rmse"]),
        section("walk_forward", SQL["walk_forward_trend"], ["steps", "mean_error", "trend", "r2"]),
        section("cpcv", SQL["cpcv_summary"], STATS),
        section("overfit", PART["backtest_overfit"], ["pbo"]),
        section("decay", DECAY, ["last_rmse", "trend"]),
        section("monte_carlo", SQL["monte_carlo_summary"], STATS),
    ]
)
SETS = lambda d: d.groupBy("batch_id").agg(F.create_map(F.lit("vol"), F.round(F.avg("vol"), 8), F.lit("volume"), F.round(F.avg("volume"), 8)).alias("params"))
add(
    "parameter_stability",
    lambda d: m.parameter_stability(SETS(d)),
    "SELECT round(greatest(0, least(1, 1 - (stddev_pop(p) / abs(avg(p)) + stddev_pop(q) / abs(avg(q))) / 2)), 6) AS stability "
    "FROM (SELECT round(avg(vol), 8) AS p, round(avg(volume), 8) AS q FROM s GROUP BY symbol, batch_id)",
)
LATE = ", so AS (SELECT * FROM s WHERE row_id >= floor(n * 0.8))"
late = lambda sql: sql.replace("FROM s ", "FROM so ").replace("FROM s)", "FROM so)")
fc, fo = forecast_sql("symbol")
rk, ro = risk_sql("symbol", "strat", "st")
add(
    "out_of_distribution",
    lambda d: m.out_of_distribution(d.withColumn("n", F.count("*").over(v.W.partitionBy("symbol"))).where("row_id >= floor(n * 0.8)").drop("n"), ["symbol"]),
    f"SELECT * FROM (SELECT * RENAME (sharpe AS forecast_sharpe) FROM ({fo})) JOIN ({ro}) USING (symbol)",
    ctes=LATE + late(fc) + late(STRAT) + rk,
)

# Trends with probabilities; the SQL has the terms of the sum by gamma functions.
_K = {1: "exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2", 0: "exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi())"}
_TERMS = lambda odd, last: f"coalesce(list_sum(list_transform(range(0, ({last})::BIGINT), lambda k: {_K[odd]} * power(c, 2 * k))), 0)"
_INSIDE = f"CASE WHEN f % 2 = 1 THEN 2 / pi() * (th + sin(th) * c * {_TERMS(1, '(f - 1) // 2')}) ELSE sin(th) * {_TERMS(0, 'f // 2')} END"
add(
    "trend_test",
    lambda d: m.trend_test(d.withColumn("part", (F.col("row_id") % 90).cast("int")), "y", "row_id", ["symbol", "part"]).drop("slope_error", "intercept"),
    f"SELECT symbol, part, n, round(slope, 6) AS slope, round(r2, 6) AS r2, round(t, 6) AS t, round(greatest(1 - {_INSIDE}, 0), 6) AS p_value FROM "
    "(SELECT *, n - 2 AS f, atan(abs(t) / sqrt(n - 2)) AS th, cos(atan(abs(t) / sqrt(n - 2))) AS c FROM "
    "(SELECT symbol, (row_id % 90)::INT AS part, count(*) AS n, regr_slope(y, row_id) AS slope, regr_r2(y, row_id) AS r2, "
    "regr_slope(y, row_id) / sqrt((1 - regr_r2(y, row_id)) * var_pop(y) / ((count(*) - 2) * var_pop(row_id))) AS t FROM s WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) > 2))",
)

# Tables behind figures
_SCORES = ["rmse", "mae", "direction_accuracy"]
_SCORE_SQL = "unnest(['rmse', 'mae', 'direction_accuracy']) AS metric, unnest([sqrt(avg(power(y - yhat, 2))), avg(abs(y - yhat)), avg((sign(y) = sign(yhat))::INT)]) AS value"
_DF3 = "(1 - 2 / pi() * (atan(abs(t) / sqrt(3)) + abs(t) / sqrt(3) / (1 + t * t / 3)))"
add(
    "decay_figure",
    lambda d: fg.decay_figure(d, _SCORES),
    f"SELECT symbol, part, metric, round(value, 6) AS value, round(slope, 6) AS slope, round({_DF3}, 6) AS p_value, round(first_value(value) OVER (PARTITION BY symbol, metric ORDER BY part) + slope * (part - 1), 6) AS trend FROM "
    "(SELECT *, slope / sqrt((1 - r2) * vy / (3 * vx)) AS t FROM (SELECT *, regr_slope(value, part) OVER v AS slope, regr_r2(value, part) OVER v AS r2, var_pop(value) OVER v AS vy, var_pop(part) OVER v AS vx FROM "
    f"(SELECT symbol, greatest(1, ceil(round(rn * 5 / (m - 1.0), 9)))::INT AS part, {_SCORE_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY row_id) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS m FROM s WHERE yhat IS NOT NULL) GROUP BY 1, 2) "
    "WINDOW v AS (PARTITION BY symbol, metric)))",
)
_NAMED = " ".join(f"WHEN {k} THEN '{n}'" for k, n in fg.REGIMES.items())
add("regime_figure", lambda d: fg.regime_figure(d, _SCORES), f"SELECT regime::BIGINT AS regime, CASE regime {_NAMED} END AS regime_name, metric, round(value, 6) AS value FROM (SELECT regime, {_SCORE_SQL} FROM s WHERE yhat IS NOT NULL GROUP BY regime)")
_BATCHES = ", ".join(f"abs(corr({f}, y))" for f in FEATURES)


def _by_batch(d):
    """Importance by correlation in each of five folds of rows."""
    folds = d.withColumn("fold", F.col("row_id") % 5).groupBy("fold").agg(*[F.abs(F.corr(f, "y")).alias(f) for f in FEATURES])
    return folds.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in FEATURES])))


add(
    "importance_figure",
    lambda d: fg.importance_figure(_by_batch(d.where("yhat is not null")), 3),
    f"SELECT feature, round(avg(i), 6) AS mean, round(stddev_pop(i), 6) AS std, row_number() OVER (ORDER BY round(avg(i), 12) DESC, feature) AS rank FROM "
    f"(SELECT row_id % 5 AS k, {listed(FEATURES, [_BATCHES])} AS i FROM s WHERE yhat IS NOT NULL GROUP BY 1) GROUP BY feature ORDER BY rank LIMIT 3",
)

# Losses
add(
    "loss_by_batch_scale",
    lambda d: lo.scaled_by_batches(d.where("yhat is not null").withColumn("residual", F.col("y") - F.col("yhat"))).select("symbol", "row_id", "scaled"),
    "SELECT symbol, row_id, round((y - yhat) / greatest(sqrt(list_reduce(seen, lambda p, q: p + 0.05 * (q - p))), 1e-8), 5) AS scaled FROM s JOIN "
    "(SELECT symbol, batch_id, list(v) OVER (PARTITION BY symbol ORDER BY batch_id) AS seen FROM (SELECT symbol, batch_id, coalesce(var_samp(y - yhat), 0) AS v "
    "FROM s WHERE yhat IS NOT NULL GROUP BY ALL)) USING (symbol, batch_id) WHERE yhat IS NOT NULL",
    5,
)
add(
    "loss_attention",
    lambda d: lo.losses(named(d)).select("symbol", "row_id", lo.attention_combined(F.col("loss"), 10).alias("combined")),
    f"SELECT symbol, row_id, round(loss / 10, 10) AS combined FROM ({PART['loss_huber']})",
    10,
)

TEN = "OVER (PARTITION BY symbol ORDER BY row_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


def _attention(d):
    """The first and last of ten steps' weights under a network of one layer, and the sum of all."""
    w = v.W.partitionBy("symbol").orderBy("row_id").rowsBetween(-9, 0)
    d = d.withColumn("history", F.when(F.count("y").over(w) == 10, F.collect_list("y").over(w)))
    found = lo.attention_weights(d, "history", [([[2.0]], [0.5])])
    return found.select("row_id", F.col("weights")[0].alias("first"), F.col("weights")[9].alias("last"), F.aggregate("weights", F.lit(0.0), lambda t, x: t + x).alias("total"))


add(
    "attention_weights",
    _attention,
    "SELECT row_id, round(exp(2 * h[1] - m) / t, 6) AS first, round(exp(2 * h[10] - m) / t, 6) AS last, CASE WHEN h IS NOT NULL THEN 1.0::DOUBLE END AS total FROM "
    "(SELECT row_id, h, 2 * list_max(h) AS m, list_sum(list_transform(h, lambda x: exp(2 * x - 2 * list_max(h)))) AS t FROM "
    f"(SELECT row_id, CASE WHEN count(y) {TEN} = 10 THEN list(y) {TEN} END AS h FROM s))",
)


# Features together
def joined(names):
    return "SELECT * FROM " + " JOIN ".join(f"({PART[n]}) q{i}" + (" USING (symbol, ts)" if i else "") for i, n in enumerate(names))


def family(name, make, parts):
    def run(spark, sf):
        columns = [c for n in parts for c in QUERIES[n](spark, sf).columns if c not in ("symbol", "ts")]
        return rounded(make(order_bars(spark, sf)), columns)

    QUERIES = {**volatility.Q, **context.Q}
    Q[name], SQL[name] = run, joined(parts)


VOLATILITY = ["rolling_volatility", "range_volatility", "vol_percentile", "vol_regime", "vol_dynamics", "vol_seasonality", "tail_risk", "drawdown", "hurst"]
family("volatility_features", a.volatility_features, VOLATILITY)
family("calendar_features", a.calendar_features, ["calendar_parts", "calendar_cycles", "calendar_effects", "holidays"])
NAMES = [f"{f}_{w}" for w in (20, 60, 120) for f in ("correlation", "beta")]
Q["cross_asset_features"] = lambda spark, sf: rounded(
    a.cross_asset_features(order_bars(spark, sf), {"ship": ship_bars(spark, sf), "freight": quantity_bars(spark, sf)}),
    [f"{n}_vs_{asset}" for asset in ("ship", "freight") for n in NAMES],
)
AGAINST = lambda asset, sql: "(SELECT symbol, ts, " + ", ".join(f"{n} AS {n}_vs_{asset}" for n in NAMES) + f" FROM ({sql}))"
SQL["cross_asset_features"] = (
    f"SELECT * FROM {AGAINST('ship', PART['rolling_beta'])} JOIN {AGAINST('freight', PART['rolling_beta'].replace('l_extendedprice', 'l_quantity'))} USING (symbol, ts)"
)

# The whole family: columns of four queries for each reference, and the target's own.
_OF = {
    "rel_strength": [f"rel_strength_{w}" for w in (5, 20, 60)], "rolling_beta": NAMES,
    "conditional_beta": ["beta_highvol_60", "beta_lowvol_60"], "hedge_ratio": ["hedge_ratio", "spread_zscore"],
}
_OWN = {n: [c for c in context.OUT[n]] for n in ("macro_proxies", "market_flags")}
_ASSETS = {"ship": "l_extendedprice", "freight": "l_quantity"}


def _cross_asset_family(spark, sf):
    d = a.cross_asset_family(order_bars(spark, sf), {"ship": ship_bars(spark, sf), "freight": quantity_bars(spark, sf)})
    digits = {"rel_strength": 5, "hedge_ratio": 5}
    wanted = [(f"{c}_vs_{asset}", digits.get(n, 6)) for asset in _ASSETS for n, columns in _OF.items() for c in columns] + [(c, 6) for columns in _OWN.values() for c in columns]
    kinds = dict(d.dtypes)
    return d.select("symbol", "ts", *[F.round(F.when(~F.isnan(c), F.col(c)), k).alias(c) if kinds[c] == "double" else F.col(c) for c, k in wanted])


def _renamed(name, asset, price):
    kept = ", ".join(f"{c} AS {c}_vs_{asset}" for c in _OF[name])
    return f"(SELECT symbol, ts, {kept} FROM ({PART[name].replace('l_extendedprice', price)}))"


Q["cross_asset_family"] = _cross_asset_family
SQL["cross_asset_family"] = "SELECT * FROM " + " JOIN ".join(
    f"{t} q{i}" + (" USING (symbol, ts)" if i else "") for i, t in enumerate([_renamed(n, x, p) for x, p in _ASSETS.items() for n in _OF] + [f"({PART[n]})" for n in _OWN])
)
_PARTS = ["calendar_parts", "calendar_cycles", "calendar_effects", "holidays", "intraday", "volume_percentile"]
Q["calendar_features_intraday"] = lambda spark, sf: rounded(a.calendar_features(event_bars(spark, sf), intraday=True), [c for n in _PARTS for c in context.OUT[n]])
SQL["calendar_features_intraday"] = joined(_PARTS).replace(ORDER_BARS, EVENT_BARS)


def _transformed(spark, sf):
    d = a.transformations(order_bars(spark, sf))
    return d.select("symbol", "ts", *[F.round(F.when(~F.isnan(c), F.col(c)), n).alias(c) for c, n in (("zscore_close", 6), ("frac_diff_close", 3), ("log_close", 6))])


Q["transformations"] = _transformed
SQL["transformations"] = (
    f"SELECT symbol, ts, zscore_close, frac_diff_close, log_close FROM ({PART['zscore_close']}) JOIN ({PART['frac_diff']}) USING (symbol, ts) "
    f"JOIN (WITH {ORDER_BARS} SELECT symbol, ts, round(ln(close), 6) AS log_close FROM b0 WHERE close > 0) USING (symbol, ts)"
)
Q["adaptive_average"] = lambda spark, sf: rounded(
    a.adaptive_average(bk.wilder_indicators(order_bars(spark, sf)).withColumn("atr", F.round("atr", 4))), ["adaptive_timeframe", "adaptive_sma"], 7
)
RANK = "(len(list_filter(va, lambda z: z < sh)) + (len(list_filter(va, lambda z: z = sh)) + 1) / 2) / len(va)"
SQL["adaptive_average"] = (
    f"SELECT symbol, ts, tf AS adaptive_timeframe, round(CASE WHEN i > 5 THEN round(list_sum(vc[len(vc) - least(i, tf) + 1:len(vc)]), 6) / least(i, tf) END, 7) AS adaptive_sma FROM "
    f"(SELECT symbol, ts, i, vc, greatest(least(coalesce(round_even(round(20 * (1 + CASE WHEN sh IS NOT NULL AND ns = 50 THEN {RANK} END), 9), 0), 20), 50), 5)::INT AS tf FROM "
    f"(SELECT symbol, ts, sh, row_number() {SERIES} AS i, list(close) {last(50)} AS vc, list_filter(list(sh) {last(50)}, lambda z: z IS NOT NULL) AS va, count(sh) {last(50)} AS ns FROM "
    f"(SELECT symbol, ts, close, round(atr / nullif(close, 0), 12) AS sh FROM (WITH {ORDER_BARS} SELECT symbol, ts, close FROM b0) JOIN ({PART['wilder_indicators']}) USING (symbol, ts))))"
)
Q["vol_of_vol"] = lambda spark, sf: rounded(a.vol_of_vol(bk.garch_filter(order_bars(spark, sf)).withColumn("garch_var", F.round("garch_var", 6))), ["vol_of_vol"], 4)
SQL["vol_of_vol"] = (
    f"SELECT symbol, ts, round(CASE WHEN count(v) {last(20)} = 20 THEN stddev_samp(v) {last(20)} END, 4) AS vol_of_vol FROM (SELECT *, sqrt(garch_var) AS v FROM ({PART['garch_filter']}))"
)

# The wide frame: the families' SQL over the same bars.
FRAME = {
    "returns_basic": ["returns"], "rolling_volatility": ["rolling_vol_20"], "tail_risk": ["var_95"], "bollinger": ["bbp"],
    "stochastic": ["stoch"], "money_flow": ["mfi", "cmf"], "oscillators": ["roc", "uo"],
}
WIDE = [c for columns in FRAME.values() for c in columns]
DIGITS = {"bbp": 4, "roc": 4, "uo": 4, "mfi": 9, "cmf": 9}  # as the families' queries round


def _wide(spark, sf):
    d = models.wide_frame(order_bars(spark, sf))
    return d.select("symbol", "ts", *[F.round(F.when(~F.isnan(c), F.col(c)), DIGITS.get(c, 6)).alias(c) for c in WIDE])


Q["feature_frame"] = _wide
SQL["feature_frame"] = f"SELECT symbol, ts, {', '.join(WIDE)} FROM " + " JOIN ".join(
    f"(SELECT symbol, ts, {', '.join(FRAME[n])} FROM ({(PART | indicators.SQL)[n].replace(EVENT_BARS, ORDER_BARS)})) q{i}" + (" USING (symbol, ts)" if i else "") for i, n in enumerate(FRAME)
)

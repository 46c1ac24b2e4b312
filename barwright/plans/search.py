"""Queries of attributions, samplers and chains over prediction samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import attribution as at
from ..operators import chains as ch
from ..operators import samplers as sp
from ..operators import training as tr
from ..operators import warping as wp
from ..operators.tuning import ParamSpec
from ..sources.samples import samples
from .models import FEATURES, named
from .validation import FOLD, ROLE, SAMPLES, tidy

Q, SQL = {}, {}


def add(name, make, sql=None, digits=6, ctes="", recursive=False):
    Q[name] = lambda spark, sf: tidy(make(samples(spark, sf)), digits)
    if sql:
        SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{SAMPLES}{ctes} {sql}"


# Attributions
PAIR = ["yhat", "mom"]
MOMENTS = "avg(yhat) AS a, avg(mom) AS b, avg(y) AS t, var_pop(yhat) AS va, var_pop(mom) AS vb, covar_pop(yhat, mom) AS ab, covar_pop(yhat, y) AS ca, covar_pop(mom, y) AS cb"
SLOPES = "(ca * vb - cb * ab) / (va * vb - ab * ab) AS wa, (cb * va - ca * ab) / (va * vb - ab * ab) AS wb"
KNOWN = "yhat IS NOT NULL AND mom IS NOT NULL AND y IS NOT NULL"
SHAP = [f"shap_{f}" for f in FEATURES]
add(
    "linear_attributions",
    lambda d: at.linear_attributions(d, PAIR, "y").select("symbol", "row_id", "shap_yhat", "shap_mom", "base"),
    "SELECT symbol, row_id, round(wa * (yhat - a), 8) AS shap_yhat, round(wb * (mom - b), 8) AS shap_mom, round(t, 8) AS base "
    f"FROM s, (SELECT *, {SLOPES} FROM (SELECT {MOMENTS} FROM s WHERE {KNOWN}))",
    8,
)
ROLES = ROLE.format(keep="row_id < r0 - 10 OR row_id > r1 + 10")
add(
    "attribution_stability",
    lambda d: at.attribution_stability(at.shap_by_fold(d, PAIR, "y", "linear")),
    "SELECT feature, round(CASE WHEN avg(i) > 0 THEN greatest(0, least(1, 1 - stddev_pop(i) / avg(i))) ELSE 0 END, 6) AS stability FROM "
    "(SELECT fold, unnest(['yhat', 'mom']) AS feature, unnest([avg(abs(wa * (yhat - a))), avg(abs(wb * (mom - b)))]) AS i FROM "
    f"(SELECT * FROM rl JOIN (SELECT *, {SLOPES} FROM (SELECT fold, {MOMENTS} FROM rl WHERE role = 'train' AND {KNOWN} GROUP BY fold)) USING (fold) WHERE role = 'test') GROUP BY fold) GROUP BY feature",
    ctes=FOLD + f", rl AS (SELECT q.*, s.y, s.yhat, s.mom FROM ({ROLES}) q JOIN s USING (symbol, row_id))",
)
add("shap_values", lambda d: at.shap_values(d, FEATURES, "y").select("symbol", "row_id", *SHAP, "base"), digits=8)
add("shap_importance", lambda d: at.shap_importance(d, FEATURES, "y"))
add("shap_importance_boosted", lambda d: at.shap_importance(d, FEATURES, "y", "gbm", n=500, trees=30))
add("shap_stability", lambda d: at.attribution_stability(at.shap_by_fold(d, FEATURES, "y")))

# Samplers
PENALTIES = [round(0.1 * i, 1) for i in range(27)]
TAIL = "avg(yhat) FILTER (test) AS tx, avg(y) FILTER (test) AS ty, covar_pop(yhat, y) FILTER (test) AS tc, var_pop(yhat) FILTER (test) AS tvx, var_pop(y) FILTER (test) AS tvy"
HEAD = "avg(yhat) FILTER ({f}) AS mx, avg(y) FILTER ({f}) AS my, covar_pop(yhat, y) FILTER ({f}) AS c, var_pop(yhat) FILTER ({f}) AS vx".format(f="NOT test AND row_id % 27 < power(3, k)")
STEPS = (
    ", sa AS (SELECT *, row_id >= floor(round(count(*) OVER (PARTITION BY symbol) * 0.8, 6)) AS test FROM s WHERE yhat IS NOT NULL AND y IS NOT NULL), "
    f"sb AS (SELECT symbol, k AS rung, {TAIL}, {HEAD} FROM sa, range(4) t(k) GROUP BY symbol, k), "
    "sc AS (SELECT *, p AS trial_id, round(p * 0.1, 1) AS penalty, c / (vx * (1 + round(p * 0.1, 1))) AS b FROM sb, range(27) u(p)), "
    "sd AS (SELECT symbol, trial_id, rung, penalty, round(-sqrt(tvy - 2 * b * tc + b * b * tvx + power(ty - my - b * (tx - mx), 2)), 13) AS score FROM sc)"
)
RUNG = (
    ", h{k} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, trial_id) AS place, {last}row_number() OVER (PARTITION BY symbol ORDER BY score DESC, trial_id) "
    "<= count(*) OVER (PARTITION BY symbol) // 3 AS kept FROM sd WHERE rung = {k}{among})"
)
HALVED = "".join(RUNG.format(k=k, last="false AND " if k == 3 else "", among=f" AND (symbol, trial_id) IN (SELECT symbol, trial_id FROM h{k - 1} WHERE kept)" if k else "") for k in range(4))
add(
    "halved_trials",
    lambda d: sp.halved(sp.ridge_steps(d, PENALTIES), ["symbol"]).drop("penalty"),
    "SELECT symbol, trial_id, rung, round(score, 9) AS score, place, kept FROM (" + " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(4)) + ")",
    9,
    STEPS + HALVED,
)
TRIAL = lambda d: d.select(F.concat_ws("-", "symbol", "rung").alias("study"), "trial_id", F.create_map(F.lit("penalty"), F.col("penalty") + 0.1).alias("params"), F.col("score").alias("value"), F.lit("COMPLETE").alias("state"))
add(
    "meta_priors",
    lambda d: sp.meta_priors(TRIAL(sp.ridge_steps(d, PENALTIES)), log=("penalty",)),
    "SELECT 'penalty' AS param, count(DISTINCT (symbol, rung)) AS studies, count(*) AS n, round(avg(ln(penalty + 0.1)), 6) AS centre, round(stddev_pop(ln(penalty + 0.1)), 6) AS spread, "
    "round(min(penalty + 0.1)::DOUBLE, 6) AS low, round(max(penalty + 0.1)::DOUBLE, 6) AS high FROM "
    "(SELECT *, row_number() OVER (PARTITION BY symbol, rung ORDER BY score DESC, trial_id) AS nth FROM sd) WHERE nth <= 3",
    ctes=STEPS,
)
SPACE = [ParamSpec("penalty", 0.01, 10.0, log=True), ParamSpec("window", 0.05, 1.0)]


def told(trials):
    return trials.select("study", "trial_id", F.col("params")["penalty"].alias("penalty"), F.col("params")["window"].alias("window"), "value")


for sampler in ("tpe", "cma"):
    add(f"{sampler}_search", lambda d, s=sampler: told(sp.sampled(d.sparkSession, s, SPACE, sp.ridge_objective(d), 24, s)))
add("hyperband_search", lambda d: sp.hyperband(d.sparkSession, SPACE, lambda p, b, f=sp.ridge_objective(d): f(p, b / 9), most=9).drop("params"))


# Chains
def switched(d):
    """A filter with moments of calm and volatile rows, in blocks of 100 rows."""
    m = d.groupBy((F.col("regime") < 3).alias("s")).agg(F.avg("y").alias("m"), F.var_pop("y").alias("v")).orderBy("s").collect()
    c = ch.Chain(np.full(2, 0.5), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[r.m] for r in m]), np.array([[[r.v]] for r in m]))
    rows = ch._keyed(d, ["y"], 100)
    return ch.chain_states(rows, {r.symbol: c for r in d.select("symbol").distinct().collect()}).select("symbol", "row_id", F.col("filtered")[1].alias("probability"))


DENSITY = "exp(-power(y - m{k}, 2) / (2 * v{k})) / sqrt(v{k}) AS b{k}"
ON = ["(0.95 * a0 + 0.1 * a1) * b0", "(0.05 * a0 + 0.9 * a1) * b1"]
add(
    "switching_filter",
    switched,
    "SELECT symbol, row_id, round(a1, 6) AS probability FROM f",
    ctes=f", m AS (SELECT avg(y) FILTER (regime > 2) AS m0, var_pop(y) FILTER (regime > 2) AS v0, avg(y) FILTER (regime < 3) AS m1, var_pop(y) FILTER (regime < 3) AS v1 FROM s), "
    f"d AS MATERIALIZED (SELECT symbol, row_id, {DENSITY.format(k=0)}, {DENSITY.format(k=1)} FROM s, m), "
    "f AS (SELECT symbol, row_id, b0 / (b0 + b1) AS a0, b1 / (b0 + b1) AS a1 FROM d WHERE row_id = 0 UNION ALL "
    f"SELECT d.symbol, d.row_id, {ON[0]} / ({ON[0]} + {ON[1]}), {ON[1]} / ({ON[0]} + {ON[1]}) FROM f JOIN d ON d.symbol = f.symbol AND d.row_id = f.row_id + 1)",
    recursive=True,
)
add("switching_regimes", lambda d: ch.switching_regimes(d, "y", rounds=15, block=500).select("symbol", "row_id", F.col("smoothed")[1].alias("probability"), "state"))
add("block_hidden_states", lambda d: ch.likeliest_states(*reversed(ch.fit_chains(d, ["y", "vol"], 3, rounds=15, block=500))))
add("hierarchical_states", lambda d: ch.hierarchical_states(d, "y", "vol", rounds=10, block=500))


# Training
add("loss_training", lambda d: d.sparkSession.createDataFrame(tr.train(named(d), FEATURES, t=tr.Training(rate=0.002)).history, "epoch long, loss double, k double, alpha double"), digits=8)


# Shapes of windows
add(
    "shape_windows",
    lambda d: wp.windows(d, "y").select("symbol", "start", F.col("values")[0].alias("first"), F.col("values")[19].alias("last"), F.array_max("values").alias("highest")),
    "SELECT symbol, start, round((v[1] - m) / sd, 6) AS first, round((v[20] - m) / sd, 6) AS last, round((list_max(v) - m) / sd, 6) AS highest FROM "
    "(SELECT symbol, s0 AS start, list(y ORDER BY row_id) AS v, avg(y) AS m, stddev_pop(y) AS sd, count(y) AS many FROM s, "
    "(SELECT unnest(range(0, (SELECT max(row_id) + 1 FROM s), 5)) AS s0) WHERE row_id >= s0 AND row_id < s0 + 20 GROUP BY symbol, s0) WHERE many = 20",
)
add("shape_regimes", lambda d: wp.shape_regimes(d, "y", band=5))

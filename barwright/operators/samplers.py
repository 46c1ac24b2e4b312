"""Samplers and budgets of hyperparameter search. Trials are a table of model fits; each fit is a Spark job over its rows, so
what happens here handles a few numbers a trial. Priors over many studies and the halving of a table of steps are jobs."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tuning import REPAIRS, TRIALS, ParamSpec, suggest


def place(s: ParamSpec, x: float) -> float:
    """Where a value lies in its range, from 0 to 1."""
    u = (math.log(x) - math.log(s.low)) / (math.log(s.high) - math.log(s.low)) if s.log else (x - s.low) / (s.high - s.low)
    return min(1.0, max(0.0, u))


def _repaired(space: list[ParamSpec], u: np.ndarray) -> dict:
    p = {s.name: s.at(float(min(1.0, max(0.0, v)))) for s, v in zip(space, u, strict=True)}
    for repair in REPAIRS.values():
        p = repair(p)
    return p


class Parzen:
    """A density over 0 to 1: normals cut at the borders around the points, and one wide normal for the prior. A point is as
    wide as the larger gap beside it."""

    def __init__(self, points: np.ndarray, prior: tuple[float, float] = (0.5, 1.0)):
        at = np.sort(np.asarray(points, float))
        edges = np.concatenate([[0.0], at, [1.0]])
        width = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
        self.centre = np.append(at, prior[0])
        self.width = np.append(np.clip(width, 1 / min(100, len(at) + 2), 1), prior[1])

    def _mass(self) -> np.ndarray:
        cdf = lambda z: 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
        return cdf((1 - self.centre) / self.width) - cdf(-self.centre / self.width)

    def density(self, u: np.ndarray) -> np.ndarray:
        z = (np.asarray(u, float)[:, None] - self.centre) / self.width
        return (np.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * self.width * self._mass())).mean(1)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = np.empty(n)
        for i in range(n):
            k = rng.integers(len(self.centre))
            while not 0 <= (v := rng.normal(self.centre[k], self.width[k])) <= 1:
                pass
            out[i] = v
        return out


@dataclass(frozen=True)
class Tpe:
    """Parzen estimators of good and other trials: of ``candidates`` drawn from the good ones' density, the one with the
    largest ratio of both densities is next. good: share of trials that count as good, 25 at most. startup: trials drawn
    evenly before. priors: centre and width by parameter, as ``meta_priors`` gives them, in place of the whole range."""

    good: float = 0.15
    candidates: int = 24
    startup: int = 10
    priors: dict[str, tuple[float, float]] | None = None

    def next(self, space: list[ParamSpec], told: list[tuple[dict, float]], seed: int) -> dict:
        """The next parameters after those told with their values, of which larger is better; values that aren't finite
        count as the worst."""
        n, priors = len(told), self.priors or {}
        rng = np.random.default_rng([seed, n])
        if n < self.startup:
            if not priors:
                return suggest(space, n + 1, seed)[n]
            return _repaired(space, np.array([Parzen(np.array([]), priors.get(s.name, (0.5, 1.0))).draw(rng, 1)[0] for s in space]))
        worth = [v if math.isfinite(v) else -math.inf for _, v in told]
        order = sorted(range(n), key=lambda i: (-worth[i], i))
        cut = min(25, max(1, math.ceil(self.good * n)))
        u = []
        for s in space:
            at = np.array([place(s, p[s.name]) for p, _ in told])
            prior = priors.get(s.name, (0.5, 1.0))
            best, rest = Parzen(at[order[:cut]], prior), Parzen(at[order[cut:]], prior)
            drawn = best.draw(rng, self.candidates)
            u.append(drawn[np.argmax(np.log(best.density(drawn)) - np.log(rest.density(drawn)))])
        return _repaired(space, np.array(u))


class Cma:
    """Covariance matrix adaptation over the unit cube: generations of normal draws whose centre, step size and covariance
    follow the better half. Larger values are better; values that aren't finite count as the worst."""

    def __init__(self, space: list[ParamSpec], seed: int = 42, size: int | None = None, step: float = 0.3):
        n = len(space)
        self.space, self.rng, self.n = space, np.random.default_rng(seed), n
        self.size = size or 4 + int(3 * math.log(n)) if n > 1 else size or 6
        half = self.size // 2
        w = math.log(half + 0.5) - np.log(np.arange(1, half + 1))
        self.w, self.centre, self.step = w / w.sum(), np.full(n, 0.5), step
        self.many = 1 / (self.w**2).sum()
        self.cov, self.path, self.pull = np.eye(n), np.zeros(n), np.zeros(n)
        self.cs = (self.many + 2) / (n + self.many + 5)
        self.ds = 1 + self.cs + 2 * max(0, math.sqrt((self.many - 1) / (n + 1)) - 1)
        self.cc = (4 + self.many / n) / (n + 4 + 2 * self.many / n)
        self.c1 = 2 / ((n + 1.3) ** 2 + self.many)
        self.cm = min(1 - self.c1, 2 * (self.many - 2 + 1 / self.many) / ((n + 2) ** 2 + self.many))
        self.expected, self.round = math.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n)), 0

    def ask(self) -> list[dict]:
        """A generation; draws outside the cube count from its border."""
        root = np.linalg.cholesky(self.cov)
        u = np.clip(self.centre + self.step * self.rng.normal(size=(self.size, self.n)) @ root.T, 0, 1)
        self.drawn = u
        return [_repaired(self.space, x) for x in u]

    def tell(self, values: list[float]) -> None:
        worth = [v if math.isfinite(v) else -math.inf for v in values]
        best = self.drawn[sorted(range(self.size), key=lambda i: (-worth[i], i))[: len(self.w)]]
        before, self.round = self.centre, self.round + 1
        self.centre = self.w @ best
        move = (self.centre - before) / self.step
        values_, vectors = np.linalg.eigh(self.cov)
        inverse = vectors @ np.diag(1 / np.sqrt(np.maximum(values_, 1e-20))) @ vectors.T
        self.path = (1 - self.cs) * self.path + math.sqrt(self.cs * (2 - self.cs) * self.many) * inverse @ move
        steady = np.linalg.norm(self.path) / math.sqrt(1 - (1 - self.cs) ** (2 * self.round)) < (1.4 + 2 / (self.n + 1)) * self.expected
        self.pull = (1 - self.cc) * self.pull + steady * math.sqrt(self.cc * (2 - self.cc) * self.many) * move
        each = (best - before) / self.step
        self.cov = (1 - self.c1 - self.cm) * self.cov + self.c1 * np.outer(self.pull, self.pull) + self.cm * (each.T * self.w) @ each + 1e-12 * np.eye(self.n)
        self.step = min(1.0, self.step * math.exp(self.cs / self.ds * (np.linalg.norm(self.path) / self.expected - 1)))


def sampled(spark: SparkSession, study: str, space: list[ParamSpec], objective: Callable[[dict], float], trials: int, sampler: str = "tpe", seed: int = 42, known: list[tuple[dict, float]] | None = None, tpe: Tpe = Tpe(), jobs: int = 4) -> DataFrame:
    """The table of trials of a search by ``tpe``, ``cma`` or ``random``. ``known`` trials with their values are told first.
    A generation of cma, and random draws, run ``jobs`` at a time, as concurrent Spark jobs."""
    told, rows = list(known or []), []

    def add(params: dict, value: float) -> None:
        told.append((params, value))
        rows.append((study, len(rows), {k: float(v) for k, v in params.items()}, float(value), "COMPLETE"))

    if sampler == "tpe":
        for _ in range(trials):
            params = tpe.next(space, told, seed)
            add(params, objective(params))
    elif sampler in ("cma", "random"):
        cma = Cma(space, seed)
        with ThreadPoolExecutor(jobs) as pool:
            while len(rows) < trials:
                drawn = cma.ask() if sampler == "cma" else suggest(space, trials, seed)
                values = list(pool.map(objective, drawn))
                for params, value in zip(drawn, values, strict=True):
                    if len(rows) < trials:
                        add(params, value)
                if sampler == "cma":
                    cma.tell(values)
    else:
        raise ValueError(f"unknown sampler {sampler}; known: tpe, cma, random")
    return spark.createDataFrame(rows, TRIALS)


RUNGS = "bracket int, rung int, trial_id long, budget double, params map<string,double>, value double, kept boolean"


def hyperband(spark: SparkSession, space: list[ParamSpec], objective: Callable[[dict, float], float], most: float = 27, least: float = 1, factor: int = 3, seed: int = 42, jobs: int = 4) -> DataFrame:
    """The table of rungs of Hyperband: brackets from many trials on small budgets to few on the whole one. A rung's trials
    run ``jobs`` at a time, as concurrent Spark jobs; its best 1 / factor, the earliest of ties, go on with ``factor``
    times the budget (a share of rows, rounds or whatever the objective makes of it). Larger values are better."""
    top = int(math.log(most / least) / math.log(factor) + 1e-9)
    drawn, rows, first = iter(suggest(space, sum(math.ceil((top + 1) / (s + 1) * factor**s) for s in range(top + 1)), seed)), [], 0
    with ThreadPoolExecutor(jobs) as pool:
        for s in range(top, -1, -1):
            n = math.ceil((top + 1) / (s + 1) * factor**s)
            here = [(first + i, next(drawn)) for i in range(n)]
            first += n
            for rung in range(s + 1):
                budget = most / factor ** (s - rung)
                values = [v if math.isfinite(v) else -math.inf for v in pool.map(lambda x: objective(x[1], budget), here)]  # noqa: B023
                keep = len(here) // factor if rung < s else 0
                order = sorted(range(len(here)), key=lambda i: (-values[i], here[i][0]))[:keep]
                rows += [(top - s, rung, t, float(budget), {k: float(v) for k, v in p.items()}, float(v), i in order) for i, ((t, p), v) in enumerate(zip(here, values, strict=True))]
                here = [here[i] for i in sorted(order)]
    return spark.createDataFrame(rows, RUNGS)


def halved(steps: DataFrame, by: list[str], factor: int = 3, rungs: int = 4) -> DataFrame:
    """Successive halving over a table of (by, trial_id, rung, score), larger scores better: the rows that are reached, with
    ``place`` and ``kept``. Of a rung's trials that got there, the best 1 / factor go on, the earlier id of ties. A null
    score is the worst. There is one window a rung, none over all rows."""
    alive, out = steps.where("rung = 0").select(*by, "trial_id"), None
    for k in range(rungs):
        here = steps.where(F.col("rung") == k).join(alive, [*by, "trial_id"])
        w = W.partitionBy(*by)
        here = here.withColumns({"place": F.row_number().over(w.orderBy(F.desc_nulls_last("score"), "trial_id")), "__n": F.count("*").over(w)})
        here = here.withColumn("kept", (F.col("place") <= F.floor(F.col("__n") / factor)) & F.lit(k + 1 < rungs)).drop("__n")
        out = here if out is None else out.unionByName(here)
        alive = here.where("kept").select(*by, "trial_id")
    return out


def meta_priors(trials: DataFrame, share: float = 0.1, log: tuple[str, ...] = ()) -> DataFrame:
    """(param, studies, n, centre, spread, low, high) over the best share of every study's completed trials, one at least:
    what has been good before. Parameters in ``log`` are taken by their logarithm."""
    w = W.partitionBy("study")
    ranked = trials.where("state = 'COMPLETE'").withColumns({"__k": F.row_number().over(w.orderBy(F.desc("value"), "trial_id")), "__n": F.count("*").over(w)})
    best = ranked.where(F.col("__k") <= F.ceil(F.col("__n") * share)).select("study", F.explode("params").alias("param", "x"))
    x = F.when(F.col("param").isin(*log), F.ln("x")).otherwise(F.col("x")) if log else F.col("x")
    return best.groupBy("param").agg(F.countDistinct("study").alias("studies"), F.count("*").alias("n"), F.avg(x).alias("centre"), F.stddev_pop(x).alias("spread"), F.min("x").alias("low"), F.max("x").alias("high"))


def prior_places(priors: DataFrame, space: list[ParamSpec], widest: float = 1.0) -> dict[str, tuple[float, float]]:
    """The priors as the sampler takes them: centre and width within each parameter's range, one row a parameter."""
    found = {r.param: r for r in priors.collect()}
    out = {}
    for s in space:
        if r := found.get(s.name):
            centre = place(s, math.exp(r.centre) if s.log else r.centre)
            span = math.log(s.high / s.low) if s.log else s.high - s.low
            out[s.name] = (centre, min(widest, max(0.05, (r.spread or 0.0) / span)))
    return out


def ridge_objective(df: DataFrame, x: str = "yhat", y: str = "y", cut: float = 0.8) -> Callable[..., float]:
    """What a penalised line forecasts: parameters ``penalty`` (of the slope, per variance) and ``window`` (the latest share
    of the training rows) to less the test error, one aggregation a call. A budget under 1 trains on that share of rows."""
    rows = df.where(f"{x} is not null and {y} is not null").select("symbol", "row_id", F.col(x).alias("x"), F.col(y).alias("y")).withColumn("u", F.col("row_id") / F.count("*").over(W.partitionBy("symbol"))).cache()

    def objective(params: dict, budget: float = 1.0) -> float:
        share = F.pmod(F.xxhash64("row_id"), F.lit(10_000)) < int(10_000 * budget)
        role = F.when(F.col("u") >= cut, 1).when((F.col("u") >= cut * (1 - params.get("window", 1.0))) & share, 0)
        sums = rows.groupBy("symbol", role.alias("role")).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy")).where("role is not null").collect()
        by: dict[str, dict] = {}
        for r in sums:  # two rows a symbol
            by.setdefault(r.symbol, {})[r.role] = r
        error = n = 0.0
        for a, b in ((v[0], v[1]) for v in by.values() if len(v) == 2):
            slope = a.c / (a.vx * (1 + params.get("penalty", 0.0))) if a.vx else 0.0
            off = (b.my - a.my) - slope * (b.mx - a.mx)
            error, n = error + b.n * (b.vy - 2 * slope * b.c + slope * slope * b.vx + off * off), n + b.n
        return -math.sqrt(max(error, 0.0) / n) if n else -math.inf

    return objective


def ridge_steps(df: DataFrame, penalties: list[float], rungs: int = 4, factor: int = 3, x: str = "yhat", y: str = "y", cut: float = 0.8) -> DataFrame:
    """(symbol, trial_id, rung, penalty, score): every penalty's score after training on the shares 1, 1 / factor, ... of
    rows, by row_id; all from one aggregation of moments."""
    whole, w = factor ** (rungs - 1), W.partitionBy("symbol")
    rows = df.where(f"{x} is not null and {y} is not null").withColumn("test", F.col("row_id") >= F.floor(F.round(F.count("*").over(w) * cut, 6)))
    late = lambda c: F.when(F.col("test"), F.col(c))
    early = lambda c, k: F.when(~F.col("test") & (F.col("row_id") % whole < factor**k), F.col(c))
    made = [F.avg(late(x)).alias("tx"), F.avg(late(y)).alias("ty"), F.covar_pop(late(x), late(y)).alias("tc"), F.var_pop(late(x)).alias("tvx"), F.var_pop(late(y)).alias("tvy")]
    rung = lambda k: F.struct(F.lit(k).alias("rung"), F.avg(early(x, k)).alias("mx"), F.avg(early(y, k)).alias("my"), F.covar_pop(early(x, k), early(y, k)).alias("c"), F.var_pop(early(x, k)).alias("vx"))
    sums = rows.groupBy("symbol").agg(*made, F.array(*[rung(k) for k in range(rungs)]).alias("r"))
    sums = sums.select("symbol", "tx", "ty", "tc", "tvx", "tvy", F.inline("r"))
    sums = sums.select("*", F.posexplode(F.array(*map(F.lit, penalties))).alias("trial_id", "penalty"))
    slope = F.try_divide("c", F.col("vx") * (1 + F.col("penalty")))
    sums = sums.withColumn("b", slope).withColumn("off", F.col("ty") - F.col("my") - F.col("b") * (F.col("tx") - F.col("mx")))
    error = F.col("tvy") - 2 * F.col("b") * F.col("tc") + F.col("b") * F.col("b") * F.col("tvx") + F.col("off") * F.col("off")
    return sums.select("symbol", F.col("trial_id").cast("long").alias("trial_id"), "rung", "penalty", F.round(-F.sqrt(error), 13).alias("score"))

"""Parameter spaces, seeded trials, their table, and what a table of trials tells."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRIALS = "study string, trial_id long, params map<string,double>, value double, state string"


@dataclass(frozen=True)
class ParamSpec:
    name: str
    low: float
    high: float
    log: bool = False
    integer: bool = False

    def at(self, u: float) -> float:
        """The value at a place from 0 to 1 of the range."""
        x = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))) if self.log else self.low + u * (self.high - self.low)
        return float(round(x)) if self.integer else x


#: Repair rules by name: each maps parameters to parameters that are allowed.
REPAIRS: dict[str, Callable[[dict], dict]] = {
    "leaves": lambda p: p | {"num_leaves": min(p["num_leaves"], 2.0 ** p["max_depth"])} if {"num_leaves", "max_depth"} <= p.keys() else p,
    "leaf_size": lambda p: p | {"min_leaf": max(p["min_leaf"], 10.0)} if "min_leaf" in p else p,
    "child_weight": lambda p: p | {"child_weight": max(p["child_weight"], 0.5 / p["subsample"] + 1e-6)} if {"child_weight", "subsample"} <= p.keys() else p,
}


def suggest(space: list[ParamSpec], trials: int, seed: int = 42) -> list[dict]:
    """Seeded draws, repaired; the same seed gives the same trials."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trials):
        p = {s.name: s.at(float(rng.random())) for s in space}
        for repair in REPAIRS.values():
            p = repair(p)
        out.append(p)
    return out


def optimize(spark: SparkSession, study: str, candidates: list[dict], objective: Callable[[dict], float]) -> DataFrame:
    """Scores candidates (a few model fits, each a Spark job) and returns the trial table."""
    rows = [(study, i, p, float(objective(p)), "COMPLETE") for i, p in enumerate(candidates)]
    return spark.createDataFrame(rows, TRIALS)


def save_study(trials: DataFrame, path: str) -> None:
    trials.write.mode("append").partitionBy("study").parquet(path)


def load_study(spark: SparkSession, path: str, study: str) -> DataFrame:
    return spark.read.schema(TRIALS).parquet(path).where(F.col("study") == study)


def warm_start(trials: DataFrame) -> list[dict]:
    """Parameters of completed trials in their order; there are as many as model fits."""
    return [dict(r.params) for r in trials.where("state = 'COMPLETE'").orderBy("trial_id").select("params").collect()]


def history(trials: DataFrame) -> DataFrame:
    return trials.withColumn("best", F.max("value").over(W.partitionBy("study").orderBy("trial_id").rowsBetween(W.unboundedPreceding, 0)))


def meta_knowledge(trials: DataFrame, share: float = 0.1) -> DataFrame:
    """Per parameter: rank correlation with the value, and its range in the best share of trials."""
    rows = trials.where("state = 'COMPLETE'").select("trial_id", "value", F.explode("params").alias("param", "x"))
    rank = lambda c: F.rank().over(W.partitionBy("param").orderBy(c)) + (F.count("*").over(W.partitionBy("param", c)) - 1) / 2
    rows = rows.withColumns({"a": rank("x"), "b": rank("value"), "k": F.row_number().over(W.partitionBy("param").orderBy(F.desc("value"), "trial_id")), "n": F.count("*").over(W.partitionBy("param"))})
    top = F.when(F.col("k") <= F.ceil(F.col("n") * share), F.col("x"))
    return rows.groupBy("param").agg(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("correlation"), F.min(top).alias("best_min"), F.max(top).alias("best_max"), F.percentile(top, F.lit(0.5)).alias("best_median"))


def median_pruned(steps: DataFrame, startup: int = 5, warmup: int = 1) -> DataFrame:
    """Steps (trial_id, step, score) whose trial would stop: under the median of earlier trials at the same step."""
    earlier = W.partitionBy("step").orderBy("trial_id").rowsBetween(W.unboundedPreceding, -1)
    rows = steps.withColumns({"median": F.percentile("score", F.lit(0.5)).over(earlier), "seen": F.count("*").over(earlier)})
    return rows.withColumn("prune", (F.col("seen") >= startup) & (F.col("step") >= warmup) & (F.col("score") < F.col("median")))


def sensitivity(df: DataFrame, penalty: float, x: str = "yhat", y: str = "y", span: float = 0.2, points: int = 10) -> DataFrame:
    """Test error of a ridge line on a chronological 80/20 split for penalties within the span; one pass of moments."""
    rows = df.where(f"{x} is not null and {y} is not null").withColumn("cut", F.floor(F.count("*").over(W.partitionBy("symbol")) * 0.8)).withColumn("rn", F.row_number().over(W.partitionBy("symbol").orderBy("row_id")))
    grid = [penalty * (1 - span + 2 * span * i / (points - 1)) for i in range(points)]
    train, test = rows.where("rn <= cut"), rows.where("rn > cut")
    m = train.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("vx"))
    fits = m.withColumn("penalty", F.explode(F.array(*map(F.lit, grid)))).withColumn("slope", F.col("n") * F.col("cxy") / (F.col("n") * F.col("vx") + F.col("penalty")))
    return test.join(F.broadcast(fits), "symbol").groupBy("symbol", "penalty").agg(F.sqrt(F.avg((F.col(y) - F.col("my") - F.col("slope") * (F.col(x) - F.col("mx"))) ** 2)).alias("rmse"))

"""Hyperparameter tuning: a configuration, search spaces, a cross-validated objective over purged folds, regimes and the
final model. Trials are a table; every fit is a Spark job over all rows of its fold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import forecast_metrics, out_of_distribution
from .tuning import TRIALS, ParamSpec, suggest
from .validation import purged_by_days, purged_by_rows

#: Objectives: a metric of the test rows and whether more of it is better.
OBJECTIVES: dict[str, tuple[str, bool]] = {"rmse": ("rmse", False), "mae": ("mae", False), "r2": ("r2", True), "direction": ("direction_accuracy", True)}

SPACES: dict[str, list[ParamSpec]] = {
    "gbt": [ParamSpec("rounds", 5, 40, integer=True), ParamSpec("rate", 0.01, 0.3, log=True), ParamSpec("max_depth", 2, 5, integer=True), ParamSpec("subsample", 0.5, 1.0)],
    "forest": [ParamSpec("trees", 10, 100, integer=True), ParamSpec("max_depth", 2, 8, integer=True), ParamSpec("min_leaf", 1, 50, integer=True)],
    "linear": [ParamSpec("penalty", 1e-6, 1.0, log=True), ParamSpec("mix", 0.0, 1.0)],
}

#: Parameters that belong together, by what they control.
GROUPS: dict[str, tuple[str, ...]] = {
    "size": ("trees", "rounds", "max_depth", "min_leaf", "num_leaves"),
    "learning": ("rate", "subsample"),
    "penalty": ("penalty", "mix"),
}


@dataclass(frozen=True)
class TunerConfig:
    """model: of SPACES. objective: of OBJECTIVES. trials, folds, overlap, days: of the search; ``days`` purges by calendar
    instead of rows. seed: of draws and fits. patience: trials without a better one after which the search ends."""

    model: str = "gbt"
    objective: str = "rmse"
    trials: int = 20
    folds: int = 5
    overlap: int = 10
    days: int | None = None
    seed: int = 42
    patience: int | None = None


def estimator(model: str, params: dict, features: str, label: str, seed: int):
    """The MLlib estimator of a model with its parameters; an unknown model is an error."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    same = {"featuresCol": features, "labelCol": label, "predictionCol": "yhat"}
    if model == "gbt":
        return GBTRegressor(maxIter=int(params["rounds"]), stepSize=params["rate"], maxDepth=int(params["max_depth"]), subsamplingRate=params["subsample"], seed=seed, **same)
    if model == "forest":
        return RandomForestRegressor(numTrees=int(params["trees"]), maxDepth=int(params["max_depth"]), minInstancesPerNode=int(params["min_leaf"]), seed=seed, **same)
    if model == "linear":
        return LinearRegression(regParam=params["penalty"], elasticNetParam=params["mix"], **same)
    raise ValueError(f"unknown model {model}; known: {', '.join(SPACES)}")


def prepared(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Rows with the assembled features ``__x``, nulls taken as 0; rows without a target are left out."""
    from pyspark.ml.feature import VectorAssembler

    rows = df.drop("yhat") if "yhat" not in features else df.withColumnRenamed("yhat", "__yhat")
    features = ["__yhat" if f == "yhat" else f for f in features]
    return VectorAssembler(inputCols=features, outputCol="__x").transform(rows.where(F.col(target).isNotNull()).fillna(0.0, features))


def scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """Forecast metrics of rows with y and yhat."""
    return forecast_metrics(rows, by)


def cross_validated(rows: DataFrame, params: dict, c: TunerConfig, target: str) -> float:
    """The mean objective over purged folds of ``prepared`` rows; larger is better."""
    metric, more = OBJECTIVES[c.objective]
    parts = purged_by_days(rows, c.folds, c.days, c.days) if c.days is not None else purged_by_rows(rows, c.folds, c.overlap)
    parts = parts.withColumn("y", F.col(target))
    made = None
    for k in range(c.folds):
        here = parts.where(F.col("fold") == k)
        model = estimator(c.model, params, "__x", target, c.seed).fit(here.where("role = 'train'"))
        test = model.transform(here.where("role = 'test'")).select("symbol", "row_id", "fold", "y", "yhat")
        made = test if made is None else made.union(test)
    value = scores(made, ["fold"]).agg(F.avg(metric).alias("v")).first().v
    value = float("-inf") if value is None else float(value)
    return value if more else -value


def search(df: DataFrame, features: list[str], target: str, c: TunerConfig = TunerConfig(), study: str = "study", known: list[dict] | None = None, first: int = 0) -> DataFrame:
    """The table of trials. Seeded draws from the model's space, repaired; ``known`` parameters go first (warm start);
    trial numbers go on from ``first``, so a study that was saved can be continued."""
    rows = prepared(df, features, target).cache()
    drawn = suggest(SPACES[c.model], first + c.trials, c.seed)[first:]
    candidates = [*(known or []), *drawn][: c.trials]
    out, best, since = [], float("-inf"), 0
    for i, params in enumerate(candidates):
        value = cross_validated(rows, params, c, target)
        out.append((study, first + i, {k: float(v) for k, v in params.items()}, value, "COMPLETE"))
        best, since = (value, 0) if value > best else (best, since + 1)
        if c.patience is not None and since >= c.patience:
            break
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, TRIALS)


def best_params(trials: DataFrame) -> dict:
    """Parameters of the best completed trial, the earliest of ties."""
    row = trials.where("state = 'COMPLETE'").orderBy(F.desc("value"), "trial_id").select("params").first()
    return dict(row.params) if row else {}


def search_by_regime(df: DataFrame, features: list[str], target: str, regime: str, c: TunerConfig = TunerConfig(), least: int = 100) -> DataFrame:
    """One study per regime that has ``least`` rows; rows are numbered anew inside a regime, so that folds stay in order."""
    from pyspark.sql import Window as W

    sizes = df.groupBy(regime).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(regime).collect()  # one row a regime
    out = None
    for r in sizes:
        here = df.where(F.col(regime) == r[regime]).withColumn("row_id", F.row_number().over(W.partitionBy("symbol").orderBy("row_id")).cast("long") - 1)
        trials = search(here, features, target, c, study=f"{regime}={r[regime]}")
        out = trials if out is None else out.union(trials)
    return out


def fit_final(df: DataFrame, features: list[str], target: str, trials: DataFrame, c: TunerConfig = TunerConfig()) -> Callable[[DataFrame], DataFrame]:
    """Fits the best parameters on all rows; what is returned adds the forecast to other rows."""
    model = estimator(c.model, best_params(trials), "__x", target, c.seed).fit(prepared(df, features, target))
    return lambda rows: model.transform(prepared(rows, features, target)).drop("__x")


def evaluate(predict: Callable[[DataFrame], DataFrame], unseen: DataFrame, target: str, by: list[str]) -> DataFrame:
    """Forecast and risk metrics of a final model on rows that it has not seen."""
    return out_of_distribution(predict(unseen).withColumn("y", F.col(target)), by)

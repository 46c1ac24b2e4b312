"""Leakage-safe folds and out-of-sample validation. Folds are range predicates over row_id or ts; nothing is collected
but fold bounds, of which there are as many as folds."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def kfold(df: DataFrame, folds: int = 5) -> DataFrame:
    """Contiguous folds of equal size by row_id, the last takes the rest; ``n`` is the number of rows."""
    n = F.count("*").over(W.partitionBy("symbol"))
    return df.withColumn("n", n).withColumn("fold", F.least(F.floor(F.col("row_id") / F.floor(F.col("n") / folds)), F.lit(folds - 1)).cast("int"))


def bounds(df: DataFrame) -> DataFrame:
    """One row per symbol and fold: its hull in row_id and ts."""
    return df.groupBy("symbol", "fold").agg(F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def roles(df: DataFrame, hull: DataFrame, keep: Column) -> DataFrame:
    """(symbol, row_id, fold, role): test rows of each fold and those other rows that ``keep`` lets train.

    The hull table has one row per fold, so the range join multiplies rows by the number of folds and no more.
    """
    b = hull.select("symbol", F.col("fold").alias("test_fold"), "first_row", "last_row", "first_ts", "last_ts", *[c for c in hull.columns if c.startswith("x_")])
    rows = df.join(b, "symbol")
    role = F.when(F.col("fold") == F.col("test_fold"), "test").when(keep, "train")
    return rows.withColumn("role", role).where("role is not null").drop("fold").withColumnRenamed("test_fold", "fold")


def purged_by_days(df: DataFrame, folds: int = 5, purge: int = 5, embargo: int = 5) -> DataFrame:
    """Trains on rows outside the test hull widened by calendar days: purge before, embargo after."""
    f = kfold(df, folds)
    lo, hi = F.col("first_ts") - F.make_dt_interval(F.lit(purge)), F.col("last_ts") + F.make_dt_interval(F.lit(embargo))
    return roles(f, bounds(f), (F.col("ts") < lo) | (F.col("ts") > hi))


def purged_by_rows(df: DataFrame, folds: int = 5, overlap: int = 10) -> DataFrame:
    f = kfold(df, folds)
    return roles(f, bounds(f), (F.col("row_id") < F.col("first_row") - overlap) | (F.col("row_id") > F.col("last_row") + overlap))


def purged_by_span(df: DataFrame, folds: int = 5, share: float = 0.01) -> DataFrame:
    """Purges and embargoes a share of the test fold's duration, in seconds."""
    f = kfold(df, folds)
    sec = lambda x: F.unix_seconds(F.col(x).cast("timestamp"))
    gap = (sec("last_ts") - sec("first_ts")) * share
    return roles(f, bounds(f), (sec("ts") < sec("first_ts") - gap) | (sec("ts") > sec("last_ts") + gap))


def adaptive_purge(df: DataFrame, folds: int = 5, base: int = 5, scale: float = 2.0) -> DataFrame:
    """Days to purge per fold grow with the volatility at its start over the mean, clipped to 0.5 and 3; base at least."""
    f = kfold(df, folds)
    first = f.groupBy("symbol", "fold").agg(F.min_by("vol", "row_id").alias("v")).join(df.groupBy("symbol").agg(F.avg("vol").alias("m")), "symbol")
    days = F.greatest(F.lit(base), F.floor(F.round(base * F.least(F.greatest(F.try_divide(F.col("v"), F.col("m")), F.lit(0.5)), F.lit(3.0)) * scale, 9)))
    hull = bounds(f).join(first.select("symbol", "fold", days.cast("int").alias("x_days")), ["symbol", "fold"])
    day = F.make_dt_interval(F.col("x_days"))
    return roles(f, hull, (F.col("ts") < F.col("first_ts") - day) | (F.col("ts") > F.col("last_ts") + day))


def walk_forward_folds(df: DataFrame, first: float = 0.5, step: float = 0.1, embargo: float = 0.1) -> DataFrame:
    """Expanding folds: each tests the next step of rows and trains on all before less an embargo of the step."""
    n = F.count("*").over(W.partitionBy("symbol"))
    df = df.withColumn("n", n)
    size = F.floor(F.round(F.col("n") * step, 6))
    start = F.floor(F.round(F.col("n") * first, 6))
    last = F.floor((F.col("n") - start) / size) - 1
    df = df.withColumn("fold", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    lo = start + F.col("fold") * size
    role = F.when((F.col("row_id") >= lo) & (F.col("row_id") < lo + size), "test").when(F.col("row_id") < lo - F.floor(size * embargo), "train")
    return df.withColumn("role", role).where("role is not null")


def ols(rows: DataFrame, by: list[str], x: str = "yhat", y: str = "y") -> DataFrame:
    """Slope and intercept of y on x by group from one aggregation of moments."""
    return rows.where(f"{x} is not null and {y} is not null").groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def fold_scores(assigned: DataFrame, by: list[str]) -> DataFrame:
    """Test rmse of the line fitted on each group's training rows: all fits are one shuffle."""
    fit = ols(assigned.where("role = 'train'"), by)
    test = assigned.where("role = 'test' and yhat is not null").join(fit, by)
    return test.groupBy(*by).agg(F.sqrt(F.avg((F.col("y") - F.col("intercept") - F.col("slope") * F.col("yhat")) ** 2)).alias("rmse"), F.count("*").alias("n_test"))


def purge_grid(df: DataFrame, folds: int = 5, days: tuple[int, ...] = (0, 2, 5, 10, 15, 20, 30)) -> DataFrame:
    """Mean test rmse for every pair of purge and embargo days; pairs times folds are one aggregation."""
    f = kfold(df, folds)
    hull = bounds(f).select("symbol", F.col("fold").alias("test_fold"), "first_ts", "last_ts")
    grid = hull.withColumn("purge", F.explode(F.array(*map(F.lit, days)))).withColumn("embargo", F.explode(F.array(*map(F.lit, days))))
    lo, hi = F.col("first_ts") - F.make_dt_interval(F.col("purge")), F.col("last_ts") + F.make_dt_interval(F.col("embargo"))
    rows = f.join(grid, "symbol").withColumn("role", F.when(F.col("fold") == F.col("test_fold"), "test").when((F.col("ts") < lo) | (F.col("ts") > hi), "train"))
    scores = fold_scores(rows.drop("fold").withColumnRenamed("test_fold", "fold").where("role is not null"), ["symbol", "purge", "embargo", "fold"])
    return scores.groupBy("symbol", "purge", "embargo").agg(F.avg("rmse").alias("rmse"))


def walk_forward_ols(df: DataFrame, first: float = 0.3) -> DataFrame:
    """One-step forecasts of a line refitted at every row on all rows before: moments are running sums, no loop."""
    p = W.partitionBy("symbol").orderBy("row_id").rowsBetween(W.unboundedPreceding, -1)
    df = df.where("yhat is not null and y is not null")
    fit = df.withColumns({"slope": F.regr_slope("y", "yhat").over(p), "intercept": F.regr_intercept("y", "yhat").over(p), "n": F.count("*").over(W.partitionBy("symbol"))})
    return fit.where(F.col("row_id") >= F.floor(F.col("n") * first)).withColumn("forecast", F.col("intercept") + F.col("slope") * F.col("yhat"))


def cpcv(df: DataFrame, groups: int = 6, tests: int = 3, purge: int = 5) -> DataFrame:
    """Combinatorial purged folds: every choice of test groups; rows near a test group's edge don't train. Test rmse."""
    f = kfold(df, groups).withColumnRenamed("fold", "grp")
    combos = list(combinations(range(groups), tests))
    table = F.array(*[F.struct(F.lit(i).alias("combo"), F.array(*map(F.lit, c)).alias("chosen")) for i, c in enumerate(combos)])
    size = F.floor(F.col("n") / groups)
    near = F.exists("chosen", lambda g: (F.col("row_id") >= g * size - purge) & (F.col("row_id") < F.when(g == groups - 1, F.col("n")).otherwise((g + 1) * size) + purge))
    rows = f.select("*", F.inline(table)).withColumn("role", F.when(F.array_contains("chosen", F.col("grp")), "test").when(~near, "train")).where("role is not null")
    return fold_scores(rows, ["symbol", "combo"])


def backtest_overfit(scores: DataFrame, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Probability that the best of a random half ranks under the median of the other half. Draws are hashes, so they
    are the same in any engine that computes them and on every run; lower scores are better. Under four configurations of
    a symbol there is no probability, but null."""
    draw = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw")
    rows = scores.select("symbol", F.col("combo").cast("long").alias("combo"), "rmse", draw)
    mixed = F.col("draw") * 7919 + F.col("combo") * 104729 + (F.col("draw") * F.col("combo") + seed) * 1299709
    rows = rows.withColumn("h", F.pmod(mixed, F.lit(1000003)))
    each = ["symbol", "draw"]
    rows = rows.withColumn("side", F.pmod(F.row_number().over(W.partitionBy(*each).orderBy("h", "combo")), F.lit(2)))
    best = rows.where("side = 1").groupBy(*each).agg(F.min("rmse").alias("best"))
    share = lambda hit: F.avg(hit.cast("double")) * 0.5
    above = share(F.col("rmse") > F.col("best")) + share(F.col("rmse") >= F.col("best"))
    rest = rows.where("side = 0").join(best, each).groupBy(*each).agg(above.alias("above"))
    enough = scores.groupBy("symbol").agg(F.countDistinct("combo").alias("n"))
    found = rest.groupBy("symbol").agg(F.avg((F.col("above") < 0.5).cast("double")).alias("pbo"))
    return enough.join(found, "symbol", "left").select("symbol", F.when(F.col("n") >= 4, F.col("pbo")).alias("pbo"))


def decay(df: DataFrame, parts: int = 5) -> DataFrame:
    """Forecast error by quintile of the row order, and its slope over quintiles."""
    n = F.count("*").over(W.partitionBy("symbol"))
    df = df.where("yhat is not null").withColumn("rn", F.row_number().over(W.partitionBy("symbol").orderBy("row_id")) - 1).withColumn("n", n)
    df = df.withColumn("quintile", F.greatest(F.lit(1), F.ceil(F.round(F.col("rn") * parts / (F.col("n") - 1), 9))).cast("int"))
    by = df.groupBy("symbol", "quintile").agg(F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2)).alias("rmse"))
    return by.withColumn("trend", F.regr_slope("rmse", "quintile").over(W.partitionBy("symbol")))


def monte_carlo(df: DataFrame, replicates: int = 100, gap: int = 3) -> DataFrame:
    """Test rmse of lines fitted on hashed 80 % samples; rows within ``gap`` of a sampled row don't test, unless none is
    left; then all unsampled rows do."""
    rep = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("rep")
    rows = df.where("yhat is not null").select("*", rep).withColumn("picked", F.pmod(F.col("row_id") * 48271 + F.col("rep") * 69621 + F.col("row_id") * F.col("rep") * 16807, F.lit(10007)) < 8006)
    w = W.partitionBy("symbol", "rep").orderBy("row_id").rowsBetween(-gap, gap)
    rows = rows.withColumn("near", F.max(F.col("picked").cast("int")).over(w)).withColumn("free", F.sum((F.col("near") == 0).cast("int")).over(W.partitionBy("symbol", "rep")))
    role = F.when(F.col("picked"), "train").when((F.col("free") == 0) | (F.col("near") == 0), "test")
    return fold_scores(rows.withColumn("role", role).where("role is not null"), ["symbol", "rep"])


def nested_folds(assigned: DataFrame, folds: int = 3) -> DataFrame:
    """Inner folds inside the training rows of each outer fold, in the order of rows: (symbol, fold, row_id, inner_fold,
    inner_role); every inner fold trains on the other training rows of its outer fold."""
    w = W.partitionBy("symbol", "fold")
    rows = assigned.where("role = 'train'").withColumn("m", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("row_id")) - 1)
    own = F.least(F.floor(F.col("i") / F.floor(F.col("m") / folds)), F.lit(folds - 1)).cast("int")
    rows = rows.withColumn("own", own).withColumn("inner_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    role = F.when(F.col("own") == F.col("inner_fold"), "test").otherwise("train")
    return rows.select("symbol", "fold", "row_id", "inner_fold", role.alias("inner_role"))


def n_splits(df: DataFrame, method: str = "kfold", folds: int = 5, first: float = 0.5, step: float = 0.1) -> DataFrame:
    """Number of folds per symbol that a method gives."""
    n = df.groupBy("symbol").agg(F.count("*").alias("n"))
    size = F.floor(F.round(F.col("n") * step, 6))
    walks = F.floor((F.col("n") - F.floor(F.round(F.col("n") * first, 6))) / size)
    return n.select("symbol", (F.lit(folds) if method == "kfold" else walks).cast("long").alias("n_splits"))


def walk_forward_trend(df: DataFrame, first: float = 0.3) -> DataFrame:
    """Per symbol: steps of the walk, their mean error, the slope of the error over the steps and its r squared."""
    rows = walk_forward_ols(df, first).withColumn("error", F.abs(F.col("y") - F.col("forecast")))
    rows = rows.withColumn("step", F.row_number().over(W.partitionBy("symbol").orderBy("row_id")) - 1)
    return rows.groupBy("symbol").agg(
        F.count("*").alias("steps"), F.avg("error").alias("mean_error"), F.regr_slope("error", "step").alias("trend"), F.regr_r2("error", "step").alias("r2")
    )


def score_summary(scores: DataFrame, x: str = "rmse") -> DataFrame:
    """Mean, deviation, extremes and the 5th and 95th percentile of a score per symbol."""
    return scores.groupBy("symbol").agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.percentile(x, F.lit(0.05)).alias("p5"), F.percentile(x, F.lit(0.95)).alias("p95"), F.count("*").alias("n"),
    )


def best_purge(grid: DataFrame) -> DataFrame:
    """The pair of purge and embargo days with the least error per symbol; ties go to fewer days."""
    best = F.min_by(F.struct("purge", "embargo", "rmse"), F.struct(F.round("rmse", 10), "purge", "embargo"))
    return grid.groupBy("symbol").agg(best.alias("b")).select("symbol", "b.purge", "b.embargo", "b.rmse")


def split_distances(assigned: DataFrame, x: str = "y") -> DataFrame:
    """Kolmogorov-Smirnov distance of train and test per symbol and fold. Values are counted first; running sums go over
    the distinct values of a fold."""
    by = assigned.where(F.col(x).isNotNull()).groupBy("symbol", "fold", F.col(x).alias("v"))
    counts = by.agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b"))
    w = W.partitionBy("symbol", "fold")
    so_far = w.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    share = lambda c: F.try_divide(F.sum(c).over(so_far), F.sum(c).over(w))
    rows = counts.withColumn("gap", F.abs(share("a") - share("b")))
    return rows.groupBy("symbol", "fold").agg(F.max("gap").alias("ks"))


def best_split(assigned: DataFrame, x: str = "y", penalty: float = 0.1) -> DataFrame:
    """The fold whose train and test are most alike: the least distance plus a penalty for a test mean that drifts from
    that of the train rows, in train deviations. Ties go to the first fold."""
    side = lambda f, r: f(F.when(F.col("role") == r, F.col(x)))
    moved = assigned.groupBy("symbol", "fold").agg(
        F.abs(F.try_divide(side(F.avg, "test") - side(F.avg, "train"), side(F.stddev_pop, "train"))).alias("drift")
    )
    rows = split_distances(assigned, x).join(moved, ["symbol", "fold"])
    rows = rows.withColumn("score", F.round(F.col("ks") + penalty * F.coalesce("drift", F.lit(0.0)), 10))
    best = F.min_by(F.struct("fold", "ks", "score"), F.struct("score", "fold"))
    return rows.groupBy("symbol").agg(best.alias("b")).select("symbol", "b.fold", "b.ks", "b.score")


def validate(df: DataFrame, purge: bool = True, walk: bool = True, combos: bool = True, overfit: bool = True, trend: bool = True, samples: bool = True) -> DataFrame:
    """All validations asked for as one table (symbol, section, metric, value)."""
    parts = []
    if purge:
        parts.append(("purge", best_purge(purge_grid(df))))
    if walk:
        parts.append(("walk_forward", walk_forward_trend(df)))
    scores = cpcv(df) if combos or overfit else None
    if combos:
        parts.append(("cpcv", score_summary(scores)))
    if overfit:
        parts.append(("overfit", backtest_overfit(scores.withColumn("rmse", F.round("rmse", 12)))))
    if trend:
        last = decay(df).groupBy("symbol").agg(F.max_by("rmse", "quintile").alias("last_rmse"), F.first("trend").alias("trend"))
        parts.append(("decay", last))
    if samples:
        parts.append(("monte_carlo", score_summary(monte_carlo(df))))
    out = None
    for section, table in parts:
        names = [c for c in table.columns if c != "symbol"]
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
        rows = table.select("symbol", F.lit(section).alias("section"), F.inline(pairs))
        out = rows if out is None else out.union(rows)
    return out

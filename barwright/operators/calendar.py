"""Calendar features of a bar table's ts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parts(df: DataFrame) -> DataFrame:
    found = {"day_of_week": F.weekday(F.col("ts")), "day_of_month": F.dayofmonth(F.col("ts")), "month": F.month(F.col("ts")), "quarter": F.quarter(F.col("ts")), "year": F.year(F.col("ts")), "week_of_year": F.weekofyear(F.col("ts"))}
    return df.withColumns({n: e.cast("int") for n, e in found.items()})


def cyclical(df: DataFrame) -> DataFrame:
    out = {}
    for name, part, period in (("day", F.weekday(F.col("ts")), 7), ("month", F.month(F.col("ts")), 12), ("dom", F.dayofmonth(F.col("ts")), 31)):
        angle = part * (2 * math.pi / period)
        out |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
    return df.withColumns(out)


def effects(df: DataFrame) -> DataFrame:
    """Flags of meetings, quarter ends, month turns and seasons; the last days count back from the last day traded."""
    dom, month = F.dayofmonth(F.col("ts")), F.month(F.col("ts"))
    last = F.max(dom).over(W.partitionBy("symbol", F.year(F.col("ts")), F.month(F.col("ts"))))
    flags: dict[str, Column] = {
        "fomc_month": month.isin(1, 3, 5, 6, 7, 9, 11, 12), "likely_fomc_week": month.isin(1, 3, 5, 6, 7, 9, 11, 12) & dom.between(15, 22),
        "is_quarter_end": month.isin(3, 6, 9, 12) & (dom >= 25), "last_5_days_of_month": dom > last - 5, "first_3_days_of_month": dom <= 3, "month_end_window": (dom > last - 5) | (dom <= 3),
        "december_tax_effect": (month == 12) & (dom >= 15), "january_effect": (month == 1) & (dom <= 15), "summer_months": month.isin(6, 7, 8), "winter_months": month.isin(12, 1, 2),
    }
    return df.withColumns({n: e.cast("int") for n, e in flags.items()})


def intraday(df: DataFrame, market_open: int = 9, market_close: int = 16) -> DataFrame:
    """hour, minute, time_of_day and its cycle, opening, closing and lunch flags, and a U shape over the session."""
    t = F.hour(F.col("ts")) + F.minute(F.col("ts")) / 60
    mid = (market_open + market_close) / 2
    u = 1 - F.least(F.abs(t - market_open) / abs(mid - market_open), F.abs(t - market_close) / abs(mid - market_close))
    return df.withColumns({
        "hour": F.hour(F.col("ts")).cast("int"), "minute": F.minute(F.col("ts")).cast("int"), "time_of_day": t, "time_sin": F.sin(2 * math.pi * t / 24), "time_cos": F.cos(2 * math.pi * t / 24),
        "market_open_30min": ((t >= market_open) & (t < market_open + 0.5)).cast("int"), "market_close_30min": ((t >= market_close - 0.5) & (t < market_close)).cast("int"),
        "lunch_hour": ((t >= 12) & (t < 13)).cast("int"), "u_shape_pattern": u,
    })


def volume_percentile(df: DataFrame) -> DataFrame:
    """Average-tie rank of the volume among bars of the same symbol and hour, as a share of them."""
    same = W.partitionBy("symbol", F.hour(F.col("ts")))
    rank = F.rank().over(same.orderBy("volume"))
    ties = F.count("*").over(W.partitionBy("symbol", F.hour(F.col("ts")), "volume"))
    return df.withColumn("volume_percentile", (rank + (ties - 1) / 2) / F.count("*").over(same))


def _nth(year: Column, month: int, weekday: int, nth: int) -> Column:
    """The nth weekday (Monday is 0) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (nth - 1))


def holidays(df: DataFrame) -> DataFrame:
    """is_holiday, is_day_before_holiday, is_day_after_holiday for US federal holidays, fixed dates moved off weekends.

    The dates follow from the year alone, so no table is joined.
    """

    def of(year: Column) -> Column:
        def observed(month: int, day: int) -> Column:
            d = F.make_date(year, F.lit(month), F.lit(day))
            return F.date_add(d, F.when(F.weekday(d) == 5, -1).when(F.weekday(d) == 6, 1).otherwise(0))

        may = F.make_date(year, F.lit(5), F.lit(31))
        return F.array(observed(1, 1), _nth(year, 1, 0, 3), _nth(year, 2, 0, 3), F.date_sub(may, F.weekday(may)), F.when(year >= 2021, observed(6, 19)), observed(7, 4), _nth(year, 9, 0, 1), _nth(year, 10, 0, 2), observed(11, 11), _nth(year, 11, 3, 4), observed(12, 25))

    day = F.to_date(F.col("ts"))
    df = df.withColumn("__h", F.array_compact(F.concat(of(F.year(F.col("ts"))), of(F.year(F.col("ts")) + 1), of(F.year(F.col("ts")) - 1))))
    flags = {"is_holiday": day, "is_day_before_holiday": F.date_add(day, 1), "is_day_after_holiday": F.date_sub(day, 1)}
    return df.withColumns({n: F.array_contains("__h", d).cast("int") for n, d in flags.items()}).drop("__h")


def more_holidays(df: DataFrame, days: DataFrame) -> DataFrame:
    """Raises the three holiday flags on further days (a column ``day``) and the days around them. Each day and its two
    neighbours are one row of a semi-join's side, aggregated by day, so repeats and nulls make no difference."""
    near = F.explode(F.array(*[F.struct(F.date_sub("day", k).alias("__day"), F.lit(k).alias("k")) for k in (-1, 0, 1)]))
    flags = {"is_holiday": 0, "is_day_before_holiday": 1, "is_day_after_holiday": -1}
    side = days.select(F.to_date("day").alias("day")).where("day is not null").select(near.alias("x")).groupBy(F.col("x.__day").alias("__day"))
    side = side.agg(*[F.max((F.col("x.k") == k).cast("int")).alias(f"__{n}") for n, k in flags.items()])
    df = df.withColumn("__day", F.to_date("ts")).join(side, "__day", "left")
    return df.withColumns({n: F.greatest(n, F.coalesce(f"__{n}", F.lit(0))) for n in flags}).drop("__day", *[f"__{n}" for n in flags])

"""Preparation of real series: daily bars, log variances, index alignment, splits, baselines and standardisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the mean of the log of a squared standard normal number.
LOG_CHI_MEAN = -(0.5772156649015329 + math.log(2.0))


def daily_bars(df: DataFrame, series: Column, time: str, tie: str, value: Column) -> DataFrame:
    """(series, day, open, high, low, close) from single values: first and last by time, ties by tie."""
    order = F.struct(time, tie)
    return df.groupBy(series.alias("series"), F.to_date(time).alias("day")).agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"))


def time_bars(df: DataFrame, series: Column, unit: str, time: str, tie: str, value: Column) -> DataFrame:
    """daily_bars over any unit of date_trunc; day is the unit's beginning."""
    order = F.struct(time, tie)
    return df.groupBy(series.alias("series"), F.date_trunc(unit, time).alias("day")).agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"))


def stochastic_volatility(bars: DataFrame) -> DataFrame:
    """(series, day, x, y): log variance from the day's range, and the log squared return less its mean under a unit normal.

    Days without range, first days and values that aren't finite are left out.
    """
    w = Window.partitionBy("series").orderBy("day")
    rows = bars.na.drop(subset=["open", "high", "low", "close"]).where("high > low and low > 0 and close > 0").withColumn("_r", F.log(F.col("close") / F.lag("close").over(w))).where("_r is not null")
    span = F.log(F.col("high") / F.col("low"))
    rows = rows.withColumn("x", F.log(span * span / (4.0 * math.log(2.0)))).withColumn("y", F.log(F.greatest(F.col("_r") * F.col("_r"), F.lit(1e-30))) - LOG_CHI_MEAN)
    fine = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.where(fine("x") & fine("y")).select("series", "day", "x", "y")


def split_by_day(df: DataFrame, last_train: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("day") <= F.lit(last_train).cast("date")), df.where(F.col("day") > F.lit(last_train).cast("date"))


def split_by_year(df: DataFrame, last_train: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("year") <= last_train), df.where(F.col("year") > last_train)


def scaled_like(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns less train's mean, over train's population standard deviation (plus 1e-8): test rows teach nothing."""
    stats = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    return df.join(F.broadcast(stats), how="cross").select(*[c for c in df.columns if c not in columns], *[((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-8)).alias(c) for c in columns])


def ordinal(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """df with k: its place, from 0, in its series."""
    return df.withColumn("k", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))


def monthly_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join of two (year, month, value) series: x from a, y from b."""
    return a.select("year", "month", F.col("value").alias("x")).join(b.select("year", "month", F.col("value").alias("y")), ["year", "month"])


def correlation(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.corr("x", "y").alias("correlation"))


def baselines(df: DataFrame, by: str, order: str) -> DataFrame:
    """df with single_shot (the observation) and persistence (the last one; at first its own)."""
    return df.withColumn("single_shot", F.col("y")).withColumn("persistence", F.coalesce(F.lag("y").over(Window.partitionBy(by).orderBy(order)), F.col("y")))


def climatology(train: DataFrame, test: DataFrame) -> DataFrame:
    """MSE and MAE on test of the training mean of x: one row is joined to all."""
    mean = train.agg(F.avg("x").alias("_m"))
    e = F.col("x") - F.col("_m")
    return test.join(F.broadcast(mean), how="cross").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))


def naive_zero(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(F.col("x") * F.col("x")).alias("mse"))


def consecutive_pairs(df: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Rows with the next row's columns as next_...; the last row of a series is left out."""
    w = Window.partitionBy(by).orderBy(order)
    out = df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns], F.lead(F.lit(1)).over(w).alias("_more"))
    return out.where("_more is not null").drop("_more")


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns less their mean, over their population standard deviation (plus 1e-8), as std_...."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    return df.join(F.broadcast(stats), how="cross").select(*df.columns, *[((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-8)).alias(f"std_{c}") for c in columns])


def residual_covariance(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(F.var_samp(a).alias("c00"), F.covar_samp(a, b).alias("c01"), F.var_samp(b).alias("c11"))


def linear_regression(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Slope and intercept of x on y: least squares from moments."""
    slope = F.covar_pop("x", "y") / F.var_pop("y")
    return df.groupBy(*(by or [])).agg(slope.alias("slope"), (F.avg("x") - slope * F.avg("y")).alias("intercept"))

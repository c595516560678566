"""Weighted samples as tables: effective size, weighted moments, normalisation of log weights, and four ways to resample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.errors import ParamError
from tidefold.functions.rng import uniform_column
from tidefold.operators.filters import partitions_of

METHODS = ("multinomial", "systematic", "stratified", "residual")
#: Rows of a task that sorts whole groups, on average; about 500 bytes of memory each in resample.
ROWS_A_TASK = 250_000
#: Up to so many parts (spark.shuffle.sort.bypassMergeThreshold) a task that deals rows writes each at once; beyond, it sorts them by part in memory.
UNSORTED_PARTS = 200


def effective_size(df: DataFrame, group: str, weight: Column) -> DataFrame:
    """(group, ess): 1 over the sum of squared normalised weights."""
    return df.groupBy(group).agg((F.sum(weight) * F.sum(weight) / F.sum(weight * weight)).alias("ess"))


def weighted_moments(df: DataFrame, group: str, value: Column, weight: Column) -> DataFrame:
    """(group, mean, variance) of value under weight."""
    w, m = F.sum(weight), F.sum(weight * value) / F.sum(weight)
    return df.groupBy(group).agg(m.alias("mean"), (F.sum(weight * value * value) / w - m * m).alias("variance"))


def normalise_log_weights(df: DataFrame, group: str, log_weight: Column) -> DataFrame:
    """df with weight: exponentials that sum to 1 in a group. NaN and null count as no weight; a group of none is uniform."""
    w = Window.partitionBy(group)
    lw = F.when(F.isnan(log_weight) | log_weight.isNull(), float("-inf")).otherwise(log_weight)
    out = df.withColumn("_lw", lw).withColumn("_top", F.max("_lw").over(w))
    out = out.withColumn("_e", F.when(F.col("_top") == float("-inf"), 1.0).otherwise(F.exp(F.col("_lw") - F.col("_top"))))
    return out.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_lw", "_top", "_e")


def with_cumulative(df: DataFrame, group: str, order: str, weight: Column) -> DataFrame:
    """df with n, place (from 0), weight, low and high: the half-open interval of each row in [0, 1]; the last high is 1."""
    w = Window.partitionBy(group)
    running = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(order)) - 1)
    out = out.withColumn("weight", weight / F.sum(weight).over(w)).withColumn("_sum", F.sum("weight").over(running))
    out = out.withColumn("high", F.when(F.col("place") == F.col("n") - 1, 1.0).otherwise(F.col("_sum")))
    return out.withColumn("low", F.coalesce(F.lag("high").over(w.orderBy(order)), F.lit(0.0))).drop("_sum")


def dealt(df: DataFrame, group: str, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """df dealt by group over as many tasks as its number of rows needs, which is counted first; a small df is left as it is.

    The session's number of shuffle partitions is fixed, so without this a task's rows would grow with the input. Rows of
    more parts than are written unsorted are dealt twice: a file split of well compressed rows may have tens of millions,
    and a task that reads one would sort them all by part; dealt before, the tasks that sort have equal shares.
    """
    n = df.count()
    if n <= rows_a_task:
        return df
    parts = max(-(-n // rows_a_task), min(partitions_of(df), -(-10 * n // rows_a_task)))
    if parts > UNSORTED_PARTS:
        # By another hash, so that a share's rows go on to all parts; as a column of its own, since Spark makes one of two adjoining deals.
        df = df.withColumn("_share", F.xxhash64(group)).repartition(UNSORTED_PARTS, "_share").drop("_share")
    return df.repartition(parts, group)


def resample(df: DataFrame, group: str, order: str, weight: Column, method: str, seed: int = 0) -> DataFrame:
    """(group, draw, chosen): as many draws as the group has rows; chosen is the place of the row drawn.

    Interval ends and draws of a group are sorted together, and each draw takes the smallest place that an end beyond it
    has: one more sort in the same task, so a group of n rows costs n log n and streams. Tasks grow in number with the
    rows, not in size; df is counted for this, so one that is dear to compute is better stored before.
    """
    if method not in METHODS:
        raise ParamError(f"there is no resampling method {method!r}")
    rows = with_cumulative(dealt(df.select(group, order, weight.alias("_w")), group), group, order, F.col("_w"))
    if method == "residual":
        w = Window.partitionBy(group)
        rows = rows.withColumn("copies", F.floor(F.col("n") * F.col("weight")).cast("int"))
        sure = rows.select(group, F.col("place").alias("chosen"), F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))).alias("copy"))
        sure = sure.select(group, (F.row_number().over(w.orderBy("chosen", "copy")) - 1).cast("long").alias("draw"), F.col("chosen").cast("long").alias("chosen"))
        rows = rows.withColumn("_sure", F.sum("copies").over(w)).where("_sure < n").withColumn("_rest", F.col("n") * F.col("weight") - F.col("copies"))
        running = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_part", F.sum("_rest").over(running) / F.sum("_rest").over(w))
        rows = rows.withColumn("high", F.when(F.col("place") == F.col("n") - 1, 1.0).otherwise(F.col("_part"))).withColumn("low", F.coalesce(F.lag("high").over(w.orderBy(order)), F.lit(0.0)))
    else:
        rows = rows.withColumn("_sure", F.lit(0))
    # A group has as many draws as rows, so each row brings its interval and the draw of its place.
    draw = F.col("place").cast("long")
    own = F.lit(0).cast("long") if method == "systematic" else draw - F.col("_sure")
    u = uniform_column(F.lit(seed), F.col(group), own)
    spaced = method in ("systematic", "stratified")
    at = (draw + u) / F.col("n") if spaced else u
    # Spaced draws take ends beyond them, others ends at them too: at the same value draws come first, or last.
    first = F.struct(F.col("high").alias("at"), F.lit(spaced).alias("late"), F.col("place").alias("place"), F.lit(None).cast("long").alias("draw"))
    second = F.when(F.col("place") >= F.col("_sure"), F.struct(at.alias("at"), F.lit(not spaced).alias("late"), F.lit(None).cast("int").alias("place"), draw.alias("draw")))
    both = rows.select(group, F.explode(F.array(first, second)).alias("_x")).where("_x is not null").select(group, "_x.*")
    passed = F.min("place").over(Window.partitionBy(group).orderBy(F.desc("at"), "late").rowsBetween(Window.unboundedPreceding, 0))
    chosen = both.withColumn("chosen", passed.cast("long")).where("draw is not null").select(group, "draw", "chosen")
    return chosen.union(sure) if method == "residual" else chosen

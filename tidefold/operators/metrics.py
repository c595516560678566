"""Scores of filtered series as ordinary aggregates, and windows over them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidefold.errors import ParamError


def quadratic_form(e: Column, p: Column, dim: int) -> Column:
    """e' P^-1 e, with the pseudo-inverse where P is singular; null where it isn't finite. Closed forms for one and two components, NumPy on Arrow batches beyond."""
    g = lambda i, j: p[i][j]
    if dim == 1:
        out = F.when(g(0, 0) == 0, 0.0).otherwise(e[0] * e[0] / g(0, 0))
    elif dim == 2:
        det, trace = g(0, 0) * g(1, 1) - g(0, 1) * g(1, 0), g(0, 0) + g(1, 1)
        value = e[0] * e[0] * g(1, 1) - e[0] * e[1] * (g(0, 1) + g(1, 0)) + e[1] * e[1] * g(0, 0)
        # A symmetric matrix of rank one is its pseudo-inverse times the square of its trace.
        flat = e[0] * e[0] * g(0, 0) + e[0] * e[1] * (g(0, 1) + g(1, 0)) + e[1] * e[1] * g(1, 1)
        out = F.when(det != 0, value / det).when(trace != 0, flat / (trace * trace)).when(trace == 0, 0.0)
    else:
        out = _quadratic_forms(e, p)
    return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)


@F.pandas_udf(DoubleType())
def _quadratic_forms(e: pd.Series, p: pd.Series) -> pd.Series:
    out = np.full(len(e), np.nan)
    some = np.flatnonzero(e.notna().to_numpy() & p.notna().to_numpy())
    if len(some):
        errors, matrices = np.stack(e.to_numpy()[some]).astype(float), np.stack([np.stack(m) for m in p.to_numpy()[some]]).astype(float)
        fine = np.isfinite(errors).all(1) & np.isfinite(matrices).all((1, 2))
        some, errors, matrices = some[fine], errors[fine], matrices[fine]
        singular = np.linalg.det(matrices) == 0
        inverse = np.empty_like(matrices)
        inverse[~singular], inverse[singular] = np.linalg.inv(matrices[~singular]), np.linalg.pinv(matrices[singular])
        out[some] = np.einsum("ni,nij,nj->n", errors, inverse, errors)
    return pd.Series(out)


def with_nees(steps: DataFrame, dim: int, estimate: str = "x_upd", covariance: str = "p_upd") -> DataFrame:
    error = F.transform(F.arrays_zip(F.col("x_true").alias("t"), F.col(estimate).alias("e")), lambda s: s["t"] - s["e"])
    return steps.withColumn("_error", error).withColumn("nees", quadratic_form(F.col("_error"), F.col(covariance), dim)).drop("_error")


def with_nis(steps: DataFrame, dim: int) -> DataFrame:
    return steps.withColumn("nis", quadratic_form(F.col("innov"), F.col("s"), dim))


def components(steps: DataFrame, estimate: str = "x_upd") -> DataFrame:
    """(series, k, component, truth, estimate, error), a row for each component; rows without a truth are left out."""
    both = F.arrays_zip(F.col("x_true").alias("truth"), F.col(estimate).alias("estimate"))
    rows = steps.where("x_true is not null").select("series", "k", F.posexplode(both).alias("component", "_s"))
    return rows.select("series", "k", F.col("component").cast("long").alias("component"), "_s.truth", "_s.estimate", (F.col("_s.truth") - F.col("_s.estimate")).alias("error"))


def errors(steps: DataFrame, by: list[str] | None = None, estimate: str = "x_upd") -> DataFrame:
    """MSE, MAE and RMSE over all components and steps, by the columns of by (series and component are at hand)."""
    e = F.col("error")
    return components(steps, estimate).groupBy(*(by or [])).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))


def block_errors(steps: DataFrame, dim_state: int, estimate: str = "x_upd") -> DataFrame:
    """MSE and MAE of the state part and of the observation part of an augmented state."""
    first = F.col("component") < dim_state
    e = F.col("error")
    return components(steps, estimate).agg(
        F.avg(F.when(first, e * e)).alias("mse_x"), F.avg(F.when(~first, e * e)).alias("mse_y"), F.avg(F.when(first, F.abs(e))).alias("mae_x"), F.avg(F.when(~first, F.abs(e))).alias("mae_y")
    )


@dataclass(frozen=True)
class Pair:
    """Columns (arrays) to compare under a name; with covariance a NEES, with innovation and its covariance a NIS."""

    name: str
    truth: str
    estimate: str
    covariance: str | None = None
    innovation: str | None = None
    innovation_covariance: str | None = None
    dim: int = 1
    dim_y: int = 1


def compare(rows: DataFrame, pairs: list[Pair], by: str = "series") -> DataFrame:
    """Scores of any number of pairs in one scan and one aggregate: pair, by, component, mse, mae, rmse, nees, nis, n.

    A row for each pair as a whole (by and component null), by by, by component, and by both. Rows are unpivoted to a row
    a pair and component, and summed where they lie. nees and nis are of whole vectors, so null where component is set;
    they leave out values that aren't finite. A pair without truth or estimate on a row leaves that row out.
    """
    if len({p.name for p in pairs}) != len(pairs) or not pairs:
        raise ParamError("pairs need names that differ")
    none = F.lit(None).cast("double")

    def form(e: Column, c: str | None, dim: int) -> Column:
        return none if c is None else quadratic_form(e, F.col(c), dim)

    def struct(p: Pair) -> Column:
        both = F.arrays_zip(F.col(p.truth).alias("t"), F.col(p.estimate).alias("e"))
        error = F.when(F.col(p.truth).isNotNull() & F.col(p.estimate).isNotNull(), F.transform(both, lambda s: s["t"] - s["e"]))
        nis = none if p.innovation is None else form(F.col(p.innovation), p.innovation_covariance, p.dim_y)
        return F.struct(F.lit(p.name).alias("pair"), error.alias("error"), form(error, p.covariance, p.dim).alias("nees"), nis.alias("nis"))

    wide = rows.select(F.col(by), F.explode(F.array(*[struct(p) for p in pairs])).alias("_p")).where("_p.error is not null")
    long = wide.select(F.col("_p.pair").alias("pair"), by, F.posexplode("_p.error").alias("component", "error"), "_p.nees", "_p.nis").withColumn("component", F.col("component").cast("long"))
    # A vector's own scores count once, at its first component.
    once = lambda c: F.when(F.col("component") == 0, F.col(c))
    long = long.select("pair", by, "component", "error", once("nees").alias("_nees"), once("nis").alias("_nis"))
    e, whole = F.col("error"), F.grouping("component") == 1
    sets = [[F.col("pair")], [F.col("pair"), F.col(by)], [F.col("pair"), F.col("component")], [F.col("pair"), F.col(by), F.col("component")]]
    out = long.groupingSets(sets, F.col("pair"), F.col(by), F.col("component")).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(whole, F.avg("_nees")).alias("nees"), F.when(whole, F.avg("_nis")).alias("nis"), F.count("*").alias("n")
    )
    return out.select("pair", by, "component", "mse", "mae", "rmse", "nees", "nis", "n")


def slack_of(variance: Column, largest: Column) -> Column:
    """What a variance may lie below 0: fixed values."""
    return F.greatest(F.lit(1e-12), 1e-6 * largest)


def first_offenders(df: DataFrame, variance: Column, by: list[str], place: str, n: int = 5) -> DataFrame:
    """Groups with strongly negative variances: by, places (the n smallest, in order), n_bad, worst (largest size), slack.

    The largest size of a group and its count come from one aggregate; of the offenders each task keeps its own n first of
    a group before they are shuffled, so no group is ever gathered. Groups without offenders have no row; nulls don't count.
    """
    rows = df.select(*by, F.col(place).alias("_place"), variance.alias("_v"))
    scale = _renamed(rows.groupBy(*by).agg(slack_of(F.col("_v"), F.max(F.abs("_v"))).alias("slack")), by)
    bad = rows.where("_v < 0").join(scale, _same(by)).where(F.col("_v") < -F.col("slack")).select(*by, "_place", "_v", "slack")
    total = _renamed(bad.groupBy(*by).agg(F.count("*").alias("n_bad"), F.max(F.abs("_v")).alias("worst"), F.max("slack").alias("slack")), by)
    first = bad.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_place", "_v"))).where(F.col("_rank") <= n)
    first = first.groupBy(*by).agg(F.array_sort(F.collect_list("_place")).alias("places"))
    return first.join(total, _same(by)).select(*by, "places", "n_bad", "worst", "slack")


def _renamed(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_same_{c}" for c in by})


def _same(by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in by])


def degenerate_runs(steps: DataFrame, by: str = "series") -> DataFrame:
    """(by, first, last, length) of runs of steps without any weight, from n_degenerate of a particle filter: islands of k less its place."""
    lost = steps.where("n_degenerate > 0").withColumn("_island", F.col("k") - F.row_number().over(Window.partitionBy(by).orderBy("k")))
    return lost.groupBy(by, "_island").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("length")).drop("_island")


def state_part(steps: DataFrame, dim: int, estimate: str = "x_upd", covariance: str = "p_upd") -> DataFrame:
    """The first dim components of truth, estimate and covariance."""
    cut = F.transform(F.slice(F.col(covariance), 1, dim), lambda r: F.slice(r, 1, dim))
    return steps.withColumn(estimate, F.slice(estimate, 1, dim)).withColumn(covariance, cut).withColumn("x_true", F.slice("x_true", 1, dim))


def consistency(steps: DataFrame, dim_x: int, dim_y: int, by: list[str] | None = None) -> DataFrame:
    """Mean NEES and NIS, and whether NEES per component lies in [0.5, 2] (fixed values)."""
    rows = with_nis(with_nees(steps, dim_x), dim_y)
    return rows.groupBy(*(by or [])).agg(F.avg("nees").alias("nees"), F.avg("nis").alias("nis"), (F.avg("nees") / dim_x).between(0.5, 2.0).alias("calibrated"))


def whiteness(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation of each innovation component."""
    rows = steps.select(*(by or []), F.posexplode("innov").alias("component", "_i")).withColumn("component", F.col("component").cast("long"))
    return rows.groupBy(*(by or []), "component").agg(F.avg("_i").alias("innov_mean"), F.stddev_pop("_i").alias("innov_std"))


def rolling_mean(df: DataFrame, column: str, width: int, by: list[str], order: str = "k") -> DataFrame:
    """Mean over the last width rows, only where there are so many."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - width, 0)
    return df.withColumn("_n", F.count("*").over(w)).withColumn(f"{column}_mean", F.avg(column).over(w)).where(F.col("_n") == width).drop("_n")


def envelope(df: DataFrame, value: Column, variance: Column, by: list[str], sigmas: float = 2.0, place: str = "k", named: int = 5) -> DataFrame:
    """df with value, lo and hi at sigmas standard deviations.

    A negative variance within max(1e-12, 1e-6 of the largest in its group) counts as 0; a lower one is an error that
    names the group, the slack and the first named places of such rows (0: none, and place isn't read).
    """
    group = Window.partitionBy(*by)
    slack = slack_of(variance, F.max(F.abs(variance)).over(group))
    told = [F.lit("a variance is strongly negative")]
    if named:
        # The first places one by one, so that no list of a group is held: the number of each offender, then the place of each number.
        df = df.withColumn("_bad", variance < -slack).withColumn("_number", F.sum(F.col("_bad").cast("int")).over(group.orderBy(place).rowsBetween(Window.unboundedPreceding, 0)))
        first = [F.max(F.when(F.col("_bad") & (F.col("_number") == i + 1), F.col(place))).over(group) for i in range(named)]
        names = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in by]
        told = [F.concat(F.lit("strongly negative variances in "), F.concat_ws(", ", *names), F.lit(": slack "), slack.cast("string"), F.lit(f", first {place} "), F.array_join(F.filter(F.array(*first), lambda p: p.isNotNull()).cast("array<string>"), ", "))]
    bad = F.col("_bad") if named else variance < -slack
    sd = F.sqrt(F.when(bad, F.raise_error(*told)).otherwise(F.greatest(variance, F.lit(0.0))))
    return df.select("*", value.alias("value"), sd.alias("sd")).withColumn("lo", F.col("value") - sigmas * F.col("sd")).withColumn("hi", F.col("value") + sigmas * F.col("sd")).drop("sd", "_bad", "_number")


def diagonals(df: DataFrame, covariance: str, dim: int) -> DataFrame:
    """df with a column of each diagonal element."""
    return df.select("*", *[F.col(covariance)[i][i].alias(f"{covariance}_{i}") for i in range(dim)])


def window_of(df: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Rows with low <= k < high; all where that is empty."""
    if low is not None and high is None:
        raise ParamError("a window with a start needs an end")
    some = df.where((F.col("k") >= (low or 0)) & (F.col("k") < high)) if high is not None else df
    return some if high is None or not some.isEmpty() else df


def last_step(steps: DataFrame, columns: list[str], by: str = "series") -> DataFrame:
    """Each series' last row, by partial aggregation."""
    return steps.groupBy(by).agg(F.max_by(F.struct(*columns), "k").alias("_s"), F.max("k").alias("k")).select(by, "k", *[F.col(f"_s.{c}").alias(c) for c in columns])


def tail_difference(a: DataFrame, b: DataFrame, tail: int = 50) -> DataFrame:
    """Mean absolute difference of two filters' first component over each series' last steps."""
    both = a.select("series", "k", F.col("x_upd")[0].alias("_a")).join(b.select("series", "k", F.col("x_upd")[0].alias("_b")), ["series", "k"])
    last = both.groupBy("series").agg(F.max("k").alias("_last"))
    return both.join(last, "series").where(F.col("k") > F.col("_last") - tail).groupBy("series").agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("difference"))


def over_seeds(df: DataFrame, values: list[str], by: list[str], counted: bool = False) -> DataFrame:
    """Mean and population standard deviation of values over runs; values that aren't finite are left out. counted: with n, the number of runs."""
    out = [F.count("*").alias("n")] if counted else []
    for v in values:
        fine = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), F.col(v))
        out += [F.avg(fine).alias(f"{v}_mean"), F.stddev_pop(fine).alias(f"{v}_std")]
    return df.groupBy(*by).agg(*out)

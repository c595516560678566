"""Filters of one state and one observation as built-in array folds, and the gain table of linear models: no Python in the tasks.

A fold gathers a series into one row and copies its steps as they grow, so only series of at most LONGEST rows are folded;
longer ones go through filter_series, which gives the same columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.errors import FilterError, ParamError
from tidefold.functions.algebra import COLUMNS
from tidefold.operators.filters import filter_series
from tidefold.operators.kernels import Gaussian, Linear
from tidefold.plans.models import Model


#: Rows of a series that are folded in one row.
LONGEST = 1000


def _let(values: dict[str, Column], then) -> Column:
    """then(struct of values), each value computed once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then)[0]


def _wide(c) -> Column:
    return c if isinstance(c, Column) else F.lit(float(c))


def native_filter(observed: DataFrame, model: Model, longest: int = LONGEST) -> DataFrame:
    """series, k, y, x_pred, innov, s, x_upd, p_upd by the extended filter (on a linear model the linear one).

    Series are counted first; those of more than longest rows are filtered batch by batch, the others are folded. A null
    series is one of its own.
    """
    if (model.dim_x, model.dim_y) != (1, 1) or model.form == "augmented":
        raise FilterError("native folds are for models of one state and one observation")
    if longest < 1:
        raise ParamError("longest must be positive")
    long = observed.groupBy(F.col("series").alias("_long")).count().where(F.col("count") > longest).select("_long")
    if long.isEmpty():
        return _folded(observed, model)
    same = F.col("series").eqNullSafe(F.col("_long"))
    steps = filter_series(observed.join(long, same, "left_semi"), model, "epkf", output=("x_pred", "innov", "s", "x_upd", "p_upd"))
    one = lambda c: F.col(c)[0].alias(c)
    two = lambda c: F.col(c)[0][0].alias(c)
    rest = steps.select("series", "k", one("y"), one("x_pred"), one("innov"), two("s"), one("x_upd"), two("p_upd"))
    return _folded(observed.join(long, same, "left_anti"), model).unionByName(rest)


def _folded(observed: DataFrame, model: Model) -> DataFrame:
    order = [c for c in observed.columns if c.startswith("ord_")]
    rows = observed.groupBy("series").agg(F.sort_array(F.collect_list(F.struct(*order, F.col("y")[0].alias("v")))).alias("rows"))
    gain = model.prior[0, 1] / model.prior[1, 1]
    p0 = float(model.prior[0, 0] - gain * model.prior[0, 1])
    names = ("k", "y", "x_pred", "innov", "s", "x_upd", "p_upd")
    q = (model.B @ model.noise @ model.B.T) if model.linear else model.noise

    def made(*values) -> Column:
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, values, strict=True)])

    first = made(F.lit(0).cast("long"), F.col("y0"), 0.0, 0.0, 1.0, float(model.mean[0]) + float(gain) * (F.col("y0") - float(model.mean[1])), p0)

    def step(out: Column, row: Column) -> Column:
        def move(last: Column) -> Column:
            last = last["s"]
            value, by_z, by_v = model.jacobians(COLUMNS, [last["x_upd"], last["y"]])
            a, c = _wide(by_z[0][0]), _wide(by_z[1][0])
            if model.linear:
                q00, q01, q11 = (F.lit(float(q[i])) for i in ((0, 0), (0, 1), (1, 1)))
            elif model.form == "classic":
                # Unit gain: the state's noise reaches y through the slope of h alone, which is c / a.
                h = _slope(model, last["x_upd"])
                q00, q01, q11 = F.lit(float(q[0, 0])), h * float(q[0, 0]) + float(q[0, 1]), h * h * float(q[0, 0]) + 2.0 * h * float(q[0, 1]) + float(q[1, 1])
            else:
                b = [[_wide(by_v[i][j]) for j in range(2)] for i in range(2)]
                part = lambda i, j: b[i][0] * b[j][0] * float(q[0, 0]) + (b[i][0] * b[j][1] + b[i][1] * b[j][0]) * float(q[0, 1]) + b[i][1] * b[j][1] * float(q[1, 1])
                q00, q01, q11 = part(0, 0), part(0, 1), part(1, 1)
            p = last["p_upd"]
            return _let(
                {"xp": _wide(value[0]), "yp": _wide(value[1]), "pxx": a * a * p + q00, "pxy": a * c * p + q01, "pyy": c * c * p + q11, "k": last["k"] + 1},
                lambda t: _let(
                    {"g": t["pxy"] / t["pyy"], "i": row["v"] - t["yp"]},
                    lambda u: made(t["k"], row["v"], t["xp"], u["i"], t["pyy"], t["xp"] + u["g"] * u["i"], t["pxx"] - 2.0 * u["g"] * t["pxy"] + u["g"] * u["g"] * t["pyy"]),
                ),
            )

        return F.concat(out, F.array(_let({"s": F.element_at(out, -1)}, move)))

    folded = rows.withColumn("y0", F.col("rows")[0]["v"]).select("series", F.explode(F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), F.array(first), step)).alias("_s"))
    return folded.select("series", *[F.col(f"_s.{n}").alias(n) for n in names])


def _slope(model: Model, x: Column) -> Column:
    from tidefold.functions.algebra import Dual, derivatives

    moved = model.advance(COLUMNS, [x], [0.0])[0]
    out = model.measure(derivatives(COLUMNS), [Dual(_wide(moved), [1.0])], [0.0])[0]
    return _wide(out.slopes[0] if isinstance(out, Dual) else 0)


def gain_table(spark: SparkSession, model: Model, steps: int) -> DataFrame:
    """(k, gain, p_upd, s) of a linear model up to k = steps: they don't depend on observations."""
    if not isinstance(steps, int) or steps <= 0:
        raise ParamError("steps must be a positive integer")
    kernel: Gaussian = Linear(model)
    y = np.zeros((1, model.dim_y))
    state, out = kernel.start(y, np.zeros(1, np.uint64))
    rows = [(0, out["gain"][0].tolist(), out["p_upd"][0].tolist(), out["s"][0].tolist())]
    for k in range(1, steps + 1):
        state, out = kernel.step(state, y, np.zeros(1, np.uint64))
        rows.append((k, out["gain"][0].tolist(), out["p_upd"][0].tolist(), out["s"][0].tolist()))
    return spark.createDataFrame(rows, "k bigint, gain array<array<double>>, p_upd array<array<double>>, s array<array<double>>")

"""Trajectories of a model: noise is computed by column expressions, and each series is folded in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.errors import ParamError
from tidefold.functions.algebra import COLUMNS
from tidefold.functions.rng import normal_column
from tidefold.operators.filters import keys_of, nested, partitions_of, runs_of
from tidefold.operators.kernels import factor
from tidefold.plans.models import Model


def noise_columns(model: Model, seed: Column, series: Column, k: Column) -> list[Column]:
    """Noise of a step, prior draw at k = 0: a Cholesky factor times standard normals; an augmented model draws its state's part only and copies the end."""
    own = model.dim_x if model.form == "augmented" else model.dim
    normal = [normal_column(seed, series, k, F.lit(i)) for i in range(own)]
    at_start, later = factor(model.prior[None, :own, :own])[0], factor(model.noise[None, :own, :own])[0]

    def mixed(row: int) -> Column:
        def total(f: np.ndarray) -> Column:
            parts = [float(f[row, j]) * normal[j] for j in range(row + 1) if f[row, j] != 0]
            out = parts[0] if parts else F.lit(0.0)
            for p in parts[1:]:
                out = out + p
            return out

        return F.when(k == 0, float(model.mean[row]) + total(at_start)).otherwise(total(later))

    out = [mixed(i) for i in range(own)]
    return out + out[model.dim_x - model.dim_y :] if model.form == "augmented" else out


class Course:
    """Advances trajectories over batches of rows that come sorted by series; the last series' state goes over to the next batch."""

    def __init__(self, model: Model):
        self.model, self.key, self.state = model, None, None

    def run(self, keys: np.ndarray, k: np.ndarray, v: np.ndarray) -> np.ndarray:
        """z of each row, from its noise v, which is z itself at k = 0."""
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.concatenate((first, [len(keys)])))
        z = np.empty_like(v)
        state = np.zeros((len(first), v.shape[1]))
        if self.state is not None and keys[0] == self.key:
            state[0] = self.state
        for t in range(int(size.max())):
            live = np.flatnonzero(size > t)
            at = first[live] + t
            state[live] = z[at] = np.where((k[at] == 0)[:, None], v[at], self.model.g_numpy(state[live], v[at]))
        self.key, self.state = keys[-1], state[-1]
        return z


def simulate(spark: SparkSession, model: Model, steps: int, n_series: int = 1, seed: int = 42) -> DataFrame:
    """(series, k, x, y): steps + 1 rows for each of n_series trajectories. The same numbers for every partitioning."""
    return simulate_for(spark.range(n_series).select(F.col("id").alias("series"), F.lit(seed).cast("long").alias("seed")), model, steps)


def simulate_for(keys: DataFrame, model: Model, steps: int) -> DataFrame:
    """The same for a table of (series, seed)."""
    if not isinstance(steps, int) or steps <= 0:
        raise ParamError("steps must be a positive integer")
    rows = keys.select("series", "seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))).alias("k"))
    rows = rows.select("series", "k", F.array(*noise_columns(model, F.col("seed"), F.col("series"), F.col("k"))).alias("v"))
    rows = rows.repartition("series").sortWithinPartitions("series", "k")
    key_type = keys.schema["series"].dataType.simpleString()

    def run(batches):
        course = Course(model)
        for batch in batches:
            if len(batch):
                z = course.run(keys_of(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().reshape(len(batch), -1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nested(z[:, : model.dim_x]), nested(z[:, model.dim_x :])], ["series", "k", "x", "y"])

    return rows.mapInArrow(run, f"series {key_type}, k bigint, x array<double>, y array<double>")


def simulate_each(keys: DataFrame, chosen: dict[float, Model], steps: int) -> DataFrame:
    """(value, series, k, x, y) for a table of (value, series, seed): trajectories of chosen[value], all in one plan with one shuffle.

    The models must be of one size and none augmented. A value that chosen doesn't hold is an error.
    """
    if not isinstance(steps, int) or steps <= 0:
        raise ParamError("steps must be a positive integer")
    if len({(m.dim_x, m.dim_y) for m in chosen.values()}) != 1 or any(m.form == "augmented" for m in chosen.values()):
        raise ParamError("the models of a table must be of one size, and not augmented")
    dim_x, dim = next((m.dim_x, m.dim) for m in chosen.values())
    factors = {value: (m.mean, factor(m.prior[None])[0].T, factor(m.noise[None])[0].T) for value, m in chosen.items()}
    rows = keys.select("value", "series", "seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))).alias("k"))
    rows = rows.select("value", "series", "k", F.array(*[normal_column(F.col("seed"), F.col("series"), F.col("k"), F.lit(i)) for i in range(dim)]).alias("v"))
    rows = rows.repartition(partitions_of(keys), "value", "series").sortWithinPartitions("value", "series", "k")
    key_type = keys.schema["series"].dataType.simpleString()

    def run(batches):
        course, at = None, None
        for batch in batches:
            for value, part in runs_of(batch, 0):
                if value not in chosen:
                    raise ParamError(f"no model for {value}")
                if value != at:
                    course, at = Course(chosen[value]), value
                mean, start, later = factors[value]
                k, normal = part.column(2).to_numpy(), part.column(3).flatten().to_numpy().reshape(len(part), -1)
                v = np.where((k == 0)[:, None], mean + normal @ start, normal @ later)
                z = course.run(keys_of(part.column(1)), k, v)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), nested(z[:, :dim_x]), nested(z[:, dim_x:])], ["value", "series", "k", "x", "y"])

    return rows.mapInArrow(run, f"value double, series {key_type}, k bigint, x array<double>, y array<double>")


def as_observations(trajectories: DataFrame) -> DataFrame:
    """Trajectories as input of filter_series, with their truth."""
    return trajectories.select("series", F.col("k").alias("ord_0"), F.col("x").alias("x_true"), "y")


def wide(trajectories: DataFrame, dim_x: int, dim_y: int, without_x: bool = False) -> DataFrame:
    """Columns X0.. and Y0.. of (series, k, x, y)."""
    xs = [] if without_x else [F.col("x")[i].alias(f"X{i}") for i in range(dim_x)]
    return trajectories.select("series", "k", *xs, *[F.col("y")[i].alias(f"Y{i}") for i in range(dim_y)])


def grid(spark: SparkSession, model: Model, low: float = -3.0, high: float = 3.0, points: int = 13) -> DataFrame:
    """A 1x1 model over a square grid: i, j, x, y, gx, gy, displacement, its size, the Jacobian and its eigenvalues' real parts; NaN where undefined."""
    if (model.dim_x, model.dim_y) != (1, 1):
        raise ParamError("the grid is for models of one state and one observation")
    step = (high - low) / (points - 1)
    axis = lambda n: spark.range(points).select(F.col("id").alias(n))
    rows = axis("i").join(axis("j"), how="cross").select("i", "j", (F.lit(low) + F.col("i") * step).alias("x"), (F.lit(low) + F.col("j") * step).alias("y"))
    value, slopes, _ = model.jacobians(COLUMNS, [F.col("x"), F.col("y")])
    wide = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    rows = rows.select("*", wide(value[0]).alias("gx"), wide(value[1]).alias("gy"), *[wide(slopes[a][b]).alias(f"a{a}{b}") for a in range(2) for b in range(2)])
    half, det = (F.col("a00") + F.col("a11")) / 2, F.col("a00") * F.col("a11") - F.col("a01") * F.col("a10")
    root = F.sqrt(F.greatest(half * half - det, F.lit(0.0)))
    dx, dy = F.col("gx") - F.col("x"), F.col("gy") - F.col("y")
    return rows.select("*", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("size"), (half + root).alias("re_1"), (half - root).alias("re_2"))





"""Quality checks of matrix columns: closed forms for 2x2 in columns, NumPy in Arrow batches for any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.errors import CovarianceError, ParamError
from tidefold.operators.kernels import regularised, unsound

# Thresholds of the checks.
SYMMETRY_WARN, SYMMETRY_FAIL = 1e-8, 1e-5
EIGEN_WARN, EIGEN_FAIL = 1e-10, 0.0
CONDITION_WARN, CONDITION_FAIL = 1e6, 1e12
DET_WARN, DET_FAIL = 1e-10, 1e-15
RESIDUAL_WARN, RESIDUAL_FAIL = 1e-8, 1e-5
RADIUS_WARN, RADIUS_SLACK, EIGEN_ZERO = 0.99, 1e-10, 1e-8


def eigenvalues_2x2(a: Column, b: Column, d: Column) -> tuple[Column, Column]:
    """Both eigenvalues (smaller, larger) of [[a, b], [b, d]]."""
    mid = (a + d) / 2.0
    root = F.sqrt((a - d) * (a - d) / 4.0 + b * b)
    return mid - root, mid + root


def _worse(*levels: Column) -> Column:
    top = F.greatest(*levels)
    return F.when(top == 2, "FAIL").when(top == 1, "WARNING").otherwise("OK")


def _level(fail: Column, warn: Column) -> Column:
    return F.when(fail, 2).when(warn, 1).otherwise(0)


def covariance_2x2(df: DataFrame, a: Column, b: Column, d: Column) -> DataFrame:
    """df with low, high, condition and status of the symmetric matrix [[a, b], [b, d]]."""
    out = df.withColumn("_a", a).withColumn("_b", b).withColumn("_d", d)
    low, high = eigenvalues_2x2(F.col("_a"), F.col("_b"), F.col("_d"))
    out = out.withColumn("low", low).withColumn("high", high)
    size = F.greatest(F.abs("low"), F.abs("high"))
    out = out.withColumn("condition", F.when(F.least(F.abs("low"), F.abs("high")) > 0, size / F.least(F.abs("low"), F.abs("high"))).otherwise(float("inf")))
    broken = F.col("_a").isNull() | F.col("_b").isNull() | F.col("_d").isNull() | F.isnan("_a") | F.isnan("_b") | F.isnan("_d")
    diagonal = _level(F.least("_a", "_d") <= 0, F.lit(False))
    eigen = _level(F.col("low") <= EIGEN_FAIL, F.col("low") < EIGEN_WARN)
    condition = _level(F.col("condition") >= CONDITION_FAIL, F.col("condition") >= CONDITION_WARN)
    return out.withColumn("status", F.when(broken, "FAIL").otherwise(_worse(diagonal, eigen, condition))).drop("_a", "_b", "_d")


def regularise_2x2(df: DataFrame, a: Column, b: Column, d: Column) -> DataFrame:
    """df with epsilon and the regularised diagonal r_a, r_d: the smallest addition, times 10, that heals eigenvalues and condition."""
    out = df.withColumn("_a", a).withColumn("_d", d).withColumn("_b", b)
    low, high = eigenvalues_2x2(F.col("_a"), F.col("_b"), F.col("_d"))
    out = out.withColumn("_low", low).withColumn("_high", high)
    for_eigen = F.when(F.col("_low") <= EIGEN_WARN, F.abs("_low") + 10 * EIGEN_WARN).otherwise(0.0)
    ill = (F.col("_low") <= 0) | (F.col("_high") / F.when(F.col("_low") > 0, F.col("_low")) >= CONDITION_FAIL)
    need = F.when(ill, F.greatest(for_eigen, F.col("_high") / CONDITION_FAIL - F.col("_low"))).otherwise(for_eigen)
    out = out.withColumn("epsilon", 10.0 * need)
    return out.withColumn("r_a", F.col("_a") + F.col("epsilon")).withColumn("r_d", F.col("_d") + F.col("epsilon")).drop("_a", "_b", "_d", "_low", "_high")


def invertible_2x2(df: DataFrame, a: Column, b: Column, c: Column, d: Column) -> DataFrame:
    """df with det, condition, status and the inverse i00.. (null on FAIL) of [[a, b], [c, d]]."""
    out = df.withColumn("_a", a).withColumn("_b", b).withColumn("_c", c).withColumn("_d", d)
    m = {k: F.col(f"_{k}") for k in "abcd"}
    out = out.withColumn("det", m["a"] * m["d"] - m["b"] * m["c"])
    square = m["a"] * m["a"] + m["b"] * m["b"] + m["c"] * m["c"] + m["d"] * m["d"]
    # Singular values from their sum of squares and product.
    out = out.withColumn("_s", square).withColumn("_r", F.sqrt(F.greatest(F.col("_s") * F.col("_s") - 4.0 * F.col("det") * F.col("det"), F.lit(0.0))))
    out = out.withColumn("condition", F.when(F.col("det") != 0, (F.col("_s") + F.col("_r")) / (2.0 * F.abs("det"))).otherwise(float("inf")))
    size = F.abs("det")
    status = _worse(_level(size <= DET_FAIL, size <= DET_WARN), _level(F.col("condition") >= CONDITION_FAIL, F.col("condition") >= CONDITION_WARN))
    out = out.withColumn("status", status)
    fine = lambda v: F.when(F.col("status") != "FAIL", v / F.col("det"))
    out = out.withColumn("i00", fine(m["d"])).withColumn("i01", fine(-m["b"])).withColumn("i10", fine(-m["c"])).withColumn("i11", fine(m["a"]))
    return out.drop("_a", "_b", "_c", "_d", "_s", "_r")


def stability_2x2(df: DataFrame, a: Column, b: Column, c: Column, d: Column) -> DataFrame:
    """df with radius (spectral), complex (whether eigenvalues are) and status of [[a, b], [c, d]]."""
    half, det = (a + d) / 2.0, a * d - b * c
    out = df.withColumn("_h", half).withColumn("_det", det).withColumn("_q", F.col("_h") * F.col("_h") - F.col("_det"))
    out = out.withColumn("complex", F.col("_q") < 0)
    root = F.sqrt(F.abs("_q"))
    one, two = F.abs(F.col("_h") + root), F.abs(F.col("_h") - root)
    modulus = F.sqrt(F.abs("_det"))
    out = out.withColumn("radius", F.when(F.col("complex"), modulus).otherwise(F.greatest(one, two)))
    small = F.when(F.col("complex"), modulus).otherwise(F.least(one, two))
    status = _worse(_level(F.col("radius") > 1 + RADIUS_SLACK, F.col("radius") >= RADIUS_WARN), _level(F.lit(False), small < EIGEN_ZERO), _level(F.lit(False), F.col("complex")))
    return out.withColumn("status", status).drop("_h", "_det", "_q")


def _check(name: str, value: float | None, fail: bool, warn: bool) -> dict:
    return {"name": name, "status": "FAIL" if fail else "WARNING" if warn else "OK", "value": value}


def covariance_report(m: np.ndarray) -> list[dict]:
    """Checks of one matrix; what follows a failure of the first two isn't run."""
    out = [_check("finite", None, not np.isfinite(m).all(), False)]
    if out[0]["status"] == "FAIL":
        return out
    out.append(_check("square", float(m.shape[0]), m.ndim != 2 or m.shape[0] != m.shape[1], False))
    if out[1]["status"] == "FAIL":
        return out
    top = np.abs(m).max()
    gap = float(np.abs(m - m.T).max() / top) if top > 0 else 0.0
    low = float(np.linalg.eigvalsh((m + m.T) / 2).min())
    condition = float(np.linalg.cond(m))
    out.append(_check("symmetry", gap, gap > SYMMETRY_FAIL, gap > SYMMETRY_WARN))
    out.append(_check("diagonal", float(np.diag(m).min()), bool((np.diag(m) <= 0).any()), False))
    out.append(_check("eigenvalues", low, low <= EIGEN_FAIL, low < EIGEN_WARN))
    out.append(_check("condition", condition, condition >= CONDITION_FAIL, condition >= CONDITION_WARN))
    return out


def invertible_report(m: np.ndarray) -> list[dict]:
    out = [_check("finite", None, not np.isfinite(m).all(), False)]
    if out[0]["status"] == "FAIL":
        return out
    n = len(m)
    rank, det, condition = int(np.linalg.matrix_rank(m)), float(abs(np.linalg.det(m))), float(np.linalg.cond(m))
    out.append(_check("rank", float(rank), rank < n, False))
    out.append(_check("determinant", det, det <= DET_FAIL, det <= DET_WARN))
    out.append(_check("condition", condition, condition >= CONDITION_FAIL, condition >= CONDITION_WARN))
    residual = float(np.linalg.norm(np.eye(n) - m @ np.linalg.inv(m))) if rank == n else None
    out.append(_check("residual", residual, residual is None or residual >= RESIDUAL_FAIL, residual is not None and residual >= RESIDUAL_WARN))
    return out


REPORTS = {"covariance": covariance_report, "invertible": invertible_report}
_STATUS = "array<struct<name:string,status:string,value:double>>"


def matrix_report(df: DataFrame, matrix: str, kind: str = "covariance") -> DataFrame:
    """df with checks (array of name, status, value), is_ok (no warning or failure) and is_valid (no failure) of a matrix column of any size."""

    def run(batches):
        for batch in batches:
            reports = [[_check("finite", None, True, False)] if m is None or any(v is None for r in m for v in r) else REPORTS[kind](np.array(m, float)) for m in batch.column(batch.schema.get_field_index(matrix)).to_pylist()]
            kinds = pa.list_(pa.struct([("name", pa.string()), ("status", pa.string()), ("value", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reports, kinds)], [*batch.schema.names, "checks"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out = df.mapInArrow(run, f"{schema}, checks {_STATUS}")
    return out.withColumn("is_ok", ~F.exists("checks", lambda c: c["status"] != "OK")).withColumn("is_valid", ~F.exists("checks", lambda c: c["status"] == "FAIL"))


def _squares(column: pa.Array):
    """(rows, stacked matrices) of each size, of a column of matrices; rows that are null, hold a null or aren't square are in none."""
    sizes: dict[int, tuple[list, list]] = {}
    for i, m in enumerate(column.to_pylist()):
        if m and all(r is not None and len(r) == len(m) and None not in r for r in m):
            rows, some = sizes.setdefault(len(m), ([], []))
            rows.append(i)
            some.append(m)
    return [(np.array(rows), np.array(some, float)) for rows, some in sizes.values()]


def _with(df: DataFrame, matrix: str, fields: str, made) -> DataFrame:
    """df with the columns of fields from made(column of matrices), which gives an Arrow array of each."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *made(batch.column(batch.schema.get_field_index(matrix)))], [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, {fields}")


def stability(df: DataFrame, matrix: str) -> DataFrame:
    """df with radius (spectral), smallest (modulus), n_complex, moduli (falling) and status of a square matrix column of any size.

    FAIL: a modulus beyond 1, or no finite square matrix (all else is null then). WARNING: a radius of 0.99 or more, a
    modulus below 1e-8, or complex eigenvalues. Matrices of a batch are taken together, size by size.
    """

    def made(column):
        n = len(column)
        radius, smallest, several, lists, status = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, np.int64), [None] * n, np.full(n, "FAIL", object)
        for rows, m in _squares(column):
            fine = np.isfinite(m).all((1, 2))
            rows, values = rows[fine], np.linalg.eigvals(m[fine])
            moduli = -np.sort(-np.abs(values), 1)
            radius[rows], smallest[rows], several[rows] = moduli[:, 0], moduli[:, -1], (np.abs(values.imag) > 0).sum(1)
            warn = (moduli[:, 0] >= RADIUS_WARN) | (moduli[:, -1] < EIGEN_ZERO) | (several[rows] > 0)
            status[rows] = np.where(moduli[:, 0] > 1 + RADIUS_SLACK, "FAIL", np.where(warn, "WARNING", "OK"))
            for i, x in zip(rows.tolist(), moduli.tolist(), strict=True):
                lists[i] = x
        none = np.isnan(radius)
        return [pa.array(radius, mask=none), pa.array(smallest, mask=none), pa.array(several, mask=none), pa.array(lists, pa.list_(pa.float64())), pa.array(status.tolist(), pa.string())]

    return _with(df, matrix, "radius double, smallest double, n_complex bigint, moduli array<double>, status string", made)


def positive(df: DataFrame, matrix: str) -> DataFrame:
    """df with lowest (eigenvalue of the symmetric part) and positive (whether it is above 0) of a matrix column of any size; null where it is no finite square matrix."""

    def made(column):
        lowest = np.full(len(column), np.nan)
        for rows, m in _squares(column):
            fine = np.isfinite(m).all((1, 2))
            lowest[rows[fine]] = np.linalg.eigvalsh((m[fine] + np.swapaxes(m[fine], 1, 2)) / 2)[:, 0]
        none = np.isnan(lowest)
        return [pa.array(lowest, mask=none), pa.array(lowest > 0, mask=none)]

    return _with(df, matrix, "lowest double, positive boolean", made)


def regularise_any(df: DataFrame, matrix: str, epsilon: float | None = None, on_error: str = "status") -> DataFrame:
    """df with repaired (matrix), epsilon, lowest_before, lowest_after and repair: untouched, repaired or failed.

    A matrix is made symmetric, and epsilon is added to its diagonal: as given, or 0 where its eigenvalues are above 1e-10
    and its condition below 1e12, or else ten times what heals both. Then it is checked again; one that still isn't a
    covariance, or isn't finite and square, has failed: repaired is null, or with on_error="raise" an error.
    """
    if epsilon is not None and not epsilon > 0:
        raise ParamError("epsilon must be positive")
    if on_error not in ("status", "raise"):
        raise ParamError("on_error is status or raise")

    def made(column):
        n = len(column)
        new, eps, before, after, how = [None] * n, np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan), np.full(n, "failed", object)
        for rows, m in _squares(column):
            fine = np.isfinite(m).all((1, 2))
            rows, half = rows[fine], (m[fine] + np.swapaxes(m[fine], 1, 2)) / 2
            values = np.linalg.eigvalsh(half)
            low, high = values[:, 0], values[:, -1]
            if epsilon is None:
                ill = ~((low > 0) & (high > 0)) | (high >= CONDITION_FAIL * low)
                add = 10 * np.maximum(np.where(low <= EIGEN_WARN, np.abs(low) + 10 * EIGEN_WARN, 0.0), np.where(ill, high / CONDITION_FAIL - low, 0.0))
            else:
                add = np.full(len(low), float(epsilon))
            healed = half + add[:, None, None] * np.eye(half.shape[1])
            good = ~unsound(healed) if len(rows) else np.zeros(0, bool)
            eps[rows], before[rows], after[rows] = add, low, np.linalg.eigvalsh(healed)[:, 0]
            how[rows] = np.where(~good, "failed", np.where(add == 0, "untouched", "repaired"))
            for i, x, ok in zip(rows.tolist(), healed.tolist(), good.tolist(), strict=True):
                new[i] = x if ok else None
        if on_error == "raise" and (how == "failed").any():
            i = int(np.flatnonzero(how == "failed")[0])
            raise CovarianceError(f"a matrix isn't a covariance after adding {eps[i]}: {column[i].as_py()}")
        none = np.isnan(eps)
        return [pa.array(new, pa.list_(pa.list_(pa.float64()))), *[pa.array(x, mask=none) for x in (eps, before, after)], pa.array(how.tolist(), pa.string())]

    return _with(df, matrix, "repaired array<array<double>>, epsilon double, lowest_before double, lowest_after double, repair string", made)


def regularise(df: DataFrame, matrix: str) -> DataFrame:
    """df with the matrix column made symmetric and positive, all of a batch together."""

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(matrix)
            new = batch.column(place).to_pylist()
            for rows, m in _squares(batch.column(place)):
                for i, x in zip(rows.tolist(), regularised(m).tolist(), strict=True):
                    new[i] = x
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.column(place).type))

    return df.mapInArrow(run, df.schema)


def same_matrices(df: DataFrame, a: str, b: str, rtol: float = 1e-6, atol: float = 1e-12) -> DataFrame:
    """df with equal (all elements close) and distance (Frobenius) of two matrix columns."""
    flat = F.zip_with(F.flatten(a), F.flatten(b), lambda x, y: F.struct((x - y).alias("d"), y.alias("y")))
    out = df.withColumn("_z", flat)
    return out.withColumn("equal", F.forall("_z", lambda s: F.abs(s["d"]) <= atol + rtol * F.abs(s["y"]))).withColumn("distance", F.sqrt(F.aggregate("_z", F.lit(0.0), lambda t, s: t + s["d"] * s["d"]))).drop("_z")

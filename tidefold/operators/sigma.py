"""Sigma points: four sets, each a rule that gives unit points (to be scaled by a Cholesky factor) and weights."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.errors import ParamError

ALPHA, BETA, KAPPA = 0.25, 2.0, 0.0

Rule = Callable[[int, float, float, float], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _scaled(n: int, alpha: float, beta: float, kappa: float):
    """Centre, then plus and minus each axis."""
    lam = alpha * alpha * (n + kappa) - n
    axes = np.repeat(np.eye(n), 2, 0) * np.tile([1.0, -1.0], n)[:, None] * np.sqrt(n + lam)
    mean = np.full(2 * n + 1, 0.5 / (n + lam))
    mean[0] = lam / (n + lam)
    cov = mean.copy()
    cov[0] += 1 - alpha**2 + beta
    return np.vstack([np.zeros(n), axes]), mean, cov


def _cubature(n: int, alpha: float, beta: float, kappa: float):
    axes = np.repeat(np.eye(n), 2, 0) * np.tile([1.0, -1.0], n)[:, None] * np.sqrt(n)
    w = np.full(2 * n, 0.5 / n)
    return axes, w, w


def _pairs(n: int, alpha: float, beta: float, kappa: float):
    """Centre, axes and all sums of two axes."""
    axes = [s * np.eye(n)[i] for i in range(n) for s in (1.0, -1.0)]
    cross = [s * np.eye(n)[i] + t * np.eye(n)[j] for i in range(n) for j in range(i + 1, n) for s, t in product((1.0, -1.0), repeat=2)]
    mean = np.array([(n * n - 7 * n) / 18 + 1] + [(4 - n) / 18] * len(axes) + [1 / 36] * len(cross))
    cov = mean.copy()
    cov[0] += 1 - alpha**2 + beta
    return np.sqrt(3) * np.array([np.zeros(n), *axes, *cross]), mean, cov


def _hermite(n: int, alpha: float, beta: float, kappa: float):
    """All combinations of the three nodes of Gauss-Hermite quadrature on each axis."""
    nodes = ((0.0, 2 / 3), (np.sqrt(3), 1 / 6), (-np.sqrt(3), 1 / 6))
    grid = list(product(nodes, repeat=n))
    w = np.array([np.prod([p[1] for p in g]) for g in grid])
    return np.array([[p[0] for p in g] for g in grid]), w, w


_SETS: dict[str, Rule] = {"wan2000": _scaled, "cpkf": _cubature, "lerner2002": _pairs, "ito2000": _hermite}


def names() -> list[str]:
    return sorted(_SETS)


def register(key: str, rule: Rule) -> None:
    """Adds a set; a key that is taken is an error."""
    if key in _SETS:
        raise ParamError(f"sigma set {key!r} exists")
    _SETS[key] = rule


def points(key: str, n: int, alpha: float = ALPHA, beta: float = BETA, kappa: float = KAPPA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit points, weights of the mean, weights of the covariance). The mean's weights must sum to 1."""
    if key not in _SETS:
        raise ParamError(f"there is no sigma set {key!r}")
    unit, mean, cov = _SETS[key](n, alpha, beta, kappa)
    if not np.isclose(mean.sum(), 1.0, rtol=1e-5, atol=1e-12):
        raise ParamError(f"the weights of sigma set {key!r} sum to {mean.sum()}")
    return unit, mean, cov


def sigma_relation(df: DataFrame, key: str, mean: list[Column], factor: list[list[Column]]) -> DataFrame:
    """df with a row for each sigma point: point_no, point (array), w_mean, w_cov; factor is the lower Cholesky factor as columns."""
    n = len(mean)
    unit, wm, wc = points(key, n)
    rows = F.array(*[F.struct(F.array(*[F.lit(float(c)) for c in u]).alias("u"), F.lit(float(a)).alias("w_mean"), F.lit(float(b)).alias("w_cov")) for u, a, b in zip(unit, wm, wc, strict=True)])
    out = df.select("*", F.posexplode(rows).alias("point_no", "_s"))
    point = []
    for i in range(n):
        value = mean[i]
        for j in range(i + 1):
            value = value + factor[i][j] * F.col("_s.u")[j]
        point.append(value)
    return out.select(*df.columns, F.col("point_no").cast("long").alias("point_no"), F.array(*point).alias("point"), F.col("_s.w_mean").alias("w_mean"), F.col("_s.w_cov").alias("w_cov"))


def cholesky_2x2(p11: Column, p12: Column, p22: Column) -> list[list[Column]]:
    a = F.sqrt(p11)
    b = p12 / a
    return [[a, F.lit(0.0)], [b, F.sqrt(p22 - b * b)]]

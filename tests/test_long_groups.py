"""Groups too large for a row or for pairs: resampling of one group, and native folds of long series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.errors import ParamError
from tidefold.operators import native, weights
from tidefold.operators.filters import observations
from tidefold.plans import models


@pytest.mark.parametrize("method", weights.METHODS)
def test_resampling_by_plain_search(spark, method):
    """Groups with zero weights, one row, ties, and one weight that holds nearly all."""
    rng = np.random.default_rng(1)
    groups = {"zeros": [0, 3, 0, 0, 2, 1, 0], "one": [4.0], "even": [1.0] * 9, "top": [1e-9] * 30 + [1.0] + [1e-9] * 9, "some": rng.uniform(size=60).tolist()}
    df = spark.createDataFrame([(g, i, float(w)) for g, some in groups.items() for i, w in enumerate(some)], "g string, i int, w double").repartition(3)
    got = {}
    for r in weights.resample(df, "g", "i", F.col("w"), method, seed=5).collect():
        got.setdefault(r["g"], {})[r["draw"]] = r["chosen"]
    u = {(r["g"], r["d"]): r["u"] for r in df.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(70).cast("long"))).alias("d")).distinct().select("g", "d", weights.uniform_column(F.lit(5), F.col("g"), F.col("d")).alias("u")).collect()}
    for g, some in groups.items():
        w, n = np.array(some) / sum(some), len(some)
        if method == "residual":
            copies = np.floor(n * w).astype(int)
            want = np.repeat(np.arange(n), copies).tolist()
            rest = n * w - copies
            high = np.cumsum(rest) / rest.sum() if len(want) < n else None
            if high is not None:
                high[-1] = 1.0
                want += [int(np.flatnonzero(high >= u[g, d])[0]) for d in range(n - len(want))]
        else:
            high = np.cumsum(w)
            high[-1] = 1.0
            at = [u[g, d] if method == "multinomial" else (d + u[g, 0 if method == "systematic" else d]) / n for d in range(n)]
            want = [int(np.flatnonzero(high >= x if method == "multinomial" else high > x)[0]) for x in at]
        assert got[g] == dict(enumerate(want)), (g, method)


def test_a_group_of_many_rows(spark):
    n = 300_000
    out = weights.resample(spark.range(n).select(F.lit(1).alias("g"), "id", (1 + F.col("id") % 7).alias("w")), "g", "id", F.col("w"), "stratified")
    got = out.agg(F.count("*").alias("n"), F.countDistinct("draw").alias("d"), F.avg(F.col("chosen") % 7).alias("m")).first()
    assert got["n"] == got["d"] == n and got["m"] == pytest.approx(sum(k * (k + 1) for k in range(7)) / 28, abs=0.02)
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString() and "Join" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["model_x1_y1_pairwise_param", "model_x1_y1_markov_naive", "model_x1_y1_AQ_pairwise"])
def test_long_series_leave_the_fold(spark, name):
    rows = [(s, k, float(np.sin(s or 0) + np.cos(k))) for s, n in ((0, 3), (1, 40), (None, 25), (2, 1), (3, 41)) for k in range(n)]
    obs = observations(spark.createDataFrame(rows, "series bigint, k bigint, v double"), "series", ["k"], ["v"])
    model = models.create(name)
    take = lambda df: sorted((r["series"] if r["series"] is not None else -1, r["k"], *(round(r[c], 9) for c in ("y", "x_pred", "innov", "s", "x_upd", "p_upd"))) for r in df.collect())
    want = take(native.native_filter(obs, model))
    assert take(native.native_filter(obs, model, longest=24)) == want == take(native.native_filter(obs, model, longest=40)) and len(want) == 110
    with pytest.raises(ParamError):
        native.native_filter(obs, model, longest=0)


def test_one_series_of_a_hundred_thousand(spark):
    obs = observations(spark.range(100_000).select(F.lit(7).alias("s"), "id", F.sin("id").alias("v")), "s", ["id"], ["v"])
    got = native.native_filter(obs, models.pairwise_param()).agg(F.count("*").alias("n"), F.max_by("x_upd", "k").alias("x"), F.max_by("p_upd", "k").alias("p")).first()
    y, x, p = np.sin(np.arange(100_000)).tolist(), 0.0, 0.1
    for k in range(1, 100_000):
        a, c = 0.5, 0.1 * np.cos(x / 20)
        pxx, pxy, pyy = a * a * p + 0.04, a * c * p, c * c * p + 0.025
        x, p = a * x + 3 * np.tanh(y[k - 1]) + pxy / pyy * (y[k] - 0.4 * y[k - 1] - 2 * np.sin(x / 20)), pxx - pxy * pxy / pyy
    assert got["n"] == 100_000 and got["x"] == pytest.approx(x) and got["p"] == pytest.approx(p)

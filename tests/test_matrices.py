"""Matrix checks of any size, guards of the kernels, degenerate steps and early limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.errors import CovarianceError, ParamError
from tidefold.operators import diagnostics, kernels, metrics
from tidefold.operators.filters import filter_series, observations
from tidefold.plans import models

NESTED = "id int, m array<array<double>>"


def matrices(seed=0):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=(n, n)) * 0.5 for n in (1, 2, 3, 3, 4, 6) for _ in range(4)]
    out += [np.eye(3) * 0.5, np.diag([0.995, 0.1]), np.diag([1.5, 0.1]), np.diag([0.5, 1e-9]), np.array([[0.0, -0.5], [0.5, 0.0]])]
    return out


def test_stability_against_numpy(spark):
    some = matrices()
    odd = [None, [[1.0, 2.0]], [[float("nan"), 0.0], [0.0, 1.0]], [[None, 1.0], [1.0, 1.0]], []]
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(some)] + [(100 + i, m) for i, m in enumerate(odd)], NESTED).repartition(3)
    got = {r["id"]: r for r in diagnostics.stability(df, "m").collect()}
    for i, m in enumerate(some):
        values = np.linalg.eigvals(m)
        r, moduli = got[i], np.sort(np.abs(values))[::-1]
        assert np.allclose(r["moduli"], moduli) and r["radius"] == pytest.approx(moduli[0]) and r["n_complex"] == np.iscomplex(values).sum()
        assert r["status"] == ("FAIL" if moduli[0] > 1 + 1e-10 else "WARNING" if moduli[0] >= 0.99 or moduli[-1] < 1e-8 or np.iscomplex(values).any() else "OK")
    assert all(got[100 + i]["status"] == "FAIL" and got[100 + i]["radius"] is None for i in range(len(odd)))
    low = {r["id"]: (r["lowest"], r["positive"]) for r in diagnostics.positive(df, "m").collect()}
    for i, m in enumerate(some):
        want = np.linalg.eigvalsh((m + m.T) / 2).min()
        assert low[i][0] == pytest.approx(want, abs=1e-12) and low[i][1] == (want > 0)
    assert low[100] == (None, None)


def test_regularise_any(spark):
    fine, thin, bad = np.array([[2.0, 0.5], [0.5, 1.0]]), np.diag([1.0, 1e-13]), np.array([[1.0, 2.0], [2.0, 1.0]])
    rows = [(0, fine.tolist()), (1, thin.tolist()), (2, bad.tolist()), (3, [[float("inf"), 0.0], [0.0, 1.0]]), (4, None), (5, (-np.eye(3)).tolist())]
    df = spark.createDataFrame(rows, NESTED)
    got = {r["id"]: r for r in diagnostics.regularise_any(df, "m").collect()}
    assert {i: r["repair"] for i, r in got.items()} == {0: "untouched", 1: "repaired", 2: "repaired", 3: "failed", 4: "failed", 5: "repaired"}
    assert got[0]["epsilon"] == 0 and got[2]["epsilon"] == pytest.approx(10 * (1 + 1e-9)) and got[2]["lowest_after"] == pytest.approx(9 + 1e-8)
    assert got[1]["epsilon"] == pytest.approx(10 * (1e-13 + 1e-9)) and np.allclose(got[2]["repaired"], bad + got[2]["epsilon"] * np.eye(2))
    own = {r["id"]: r for r in diagnostics.regularise_any(df, "m", epsilon=0.5).collect()}
    assert own[0]["repair"] == "repaired" and own[2]["repair"] == "failed" and own[2]["repaired"] is None and own[2]["lowest_after"] == pytest.approx(-0.5)
    with pytest.raises(ParamError):
        diagnostics.regularise_any(df, "m", epsilon=0.0)
    with pytest.raises(Exception, match="isn't a covariance"):
        diagnostics.regularise_any(df, "m", on_error="raise").collect()


def test_guards_see_condition_asymmetry_and_residual():
    good = np.array([[2.0, 0.5], [0.5, 1.0]])
    ill, skew = np.diag([1.0, 1e-13]), np.array([[1.0, 0.2], [0.1, 1.0]])
    some = np.stack([good, ill, skew, np.diag([1.0, -1.0]), np.diag([1.0, 1e-11])])
    assert kernels.unsound(some).tolist() == [False, True, True, True, False]
    healed = kernels.regularised(some[1:4])
    assert not kernels.unsound(healed).any()
    s = np.stack([good, np.diag([1e3, 1e-10]), np.array([[1.0, 2.0], [2.0, 4.0]]), np.full((2, 2), np.nan), np.diag([1e6, 1e-3]), 1e-9 * np.eye(2)])
    assert kernels.invertible(s).tolist() == [True, False, False, False, True, False]
    assert kernels.invertible(np.array([[[1e-14]], [[1e-16]], [[-2.0]]])).tolist() == [True, False, True]


def test_limit_ends_a_series(spark):
    """What comes after the limit isn't filtered: not even an observation that no filter can take."""
    model = models.pairwise_param()
    rows = [(s, k, 0.1 * k if k <= 3 else 1e300) for s in range(3) for k in range(9)] + [(9, 0, 0.5), (9, 1, 0.6)]
    obs = observations(spark.createDataFrame(rows, "series bigint, k bigint, v double"), "series", ["k"], ["v"])
    got = filter_series(obs, model, "epkf", limit=3, output=("x_upd",)).collect()
    whole = {(r["series"], r["k"]): r["x_upd"] for r in filter_series(obs.where("ord_0 <= 3"), model, "epkf", output=("x_upd",)).collect()}
    assert {(r["series"], r["k"]): r["x_upd"] for r in got} == whole and len(got) == 14


@pytest.mark.parametrize("method,name", [("pf", "model_x1_y1_markov_naive"), ("ppf", "model_x1_y1_pairwise_param")])
def test_lost_weights_are_counted(spark, tables, method, name):
    """Outliers among the events take all weights; the kernel's count and the windows' runs agree."""
    events = spark.read.parquet(f"{tables}/events.parquet").where("user_id < 5")
    y = F.when((F.col("event_id") % 7).isin(2, 3), 1e200).otherwise((F.col("value") - 20) / 20)
    steps = filter_series(observations(events, "user_id", ["ts", "event_id"], [y]), models.create(name), method, output=("x_upd", "n_degenerate"), n_particles=40, on_error="skip")
    rows = steps.orderBy("series", "k").collect()
    want, open_run = [], {}
    for r in rows:
        lost = r["k"] > 0 and abs(r["y"][0]) > 1e100
        if method == "ppf":  # the next prediction starts from the outlier as well
            lost = r["n_degenerate"] > 0
        assert (r["n_degenerate"] > 0) == lost
        run = open_run.get(r["series"], 0) + 1 if lost else 0
        assert r["n_degenerate"] == run
        if run == 1:
            want.append([r["series"], r["k"], r["k"], 1])
        elif run:
            mine = [w for w in want if w[0] == r["series"]][-1]
            mine[2:] = [r["k"], run]
        open_run[r["series"]] = run
    assert sorted(map(tuple, metrics.degenerate_runs(steps).select("series", "first", "last", "length").collect())) == sorted(map(tuple, want)) and want


def test_own_filter(spark):
    class Still(kernels.Extended):
        def __init__(self, model, factor=1.0):
            super().__init__(model)
            self.factor = factor

        def predict(self, state):
            z, p = super().predict(state)
            return z * self.factor, p

    kernels.register("still", Still, ("factor",))
    try:
        obs = observations(spark.createDataFrame([(0, k, 0.1 * k) for k in range(5)], "series bigint, k bigint, v double"), "series", ["k"], ["v"])
        a, b = (filter_series(obs, models.pairwise_param(), m, **o).orderBy("k").collect() for m, o in (("still", {"factor": 1.0}), ("epkf", {})))
        assert [r["x_upd"] for r in a] == [r["x_upd"] for r in b]
        with pytest.raises(ParamError):
            kernels.register("still", Still)
    finally:
        kernels.METHODS.pop("still"), kernels._OPTIONS.pop("still")


def test_failures_are_errors_of_their_kind(spark):
    obs = observations(spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.2)], "series bigint, k bigint, v double"), "series", ["k"], ["v"])
    # A step whose prediction is too large for doubles.
    model = models.pairwise_param().with_(step=lambda fn, x, y, t, u: ([1e200 * x[0] * x[0] + t[0]], [1e200 * x[0] * x[0] + u[0]]), mean=np.array([1e9, 0.0]))
    with pytest.raises(Exception, match="InvertibilityError|CovarianceError"):
        filter_series(obs, model, "epkf").collect()
    assert issubclass(CovarianceError, Exception)

"""Experiments over values, seeds and filters, by brute force on a small grid."""

import numpy as np
import pytest

from tidefold.errors import ParamError
from tidefold.operators import kernels, metrics, sigma
from tidefold.operators.filters import Fold, filter_series
from tidefold.operators.simulate import as_observations, simulate_each, simulate_for
from tidefold.plans import catalogue, models


def scalar(y, step, p0=0.1):
    """A filter of one state: step(x, y before, p) gives the prediction (x, y, pxx, pxy, pyy)."""
    x, p, out = 0.0, p0, [(0.0, p0)]
    for k in range(1, len(y)):
        xp, yp, pxx, pxy, pyy = step(x, y[k - 1], p)
        x, p = xp + pxy / pyy * (y[k] - yp), pxx - pxy * pxy / pyy
        out.append((x, p))
    return np.array(out)


def informed(b):
    def step(x, y, p):
        a, c = 0.5, 0.1 * np.cos(x / 20)
        return a * x + b * np.tanh(y), 0.4 * y + 2 * np.sin(x / 20), a * a * p + 0.04, a * c * p, c * c * p + 0.025

    return step


def naive(x, y, p):
    pxx = 0.25 * p + 0.04
    h = 0.1 * np.cos(0.5 * x / 20)
    return 0.5 * x, 2 * np.sin(0.5 * x / 20), pxx, h * pxx, h * h * pxx + 0.025


def folded(model, method, y):
    keys = np.zeros(len(y), object)
    out = Fold(kernels.build(method, model), None, "raise").run(keys, y[:, None])[3]
    return np.stack([out["x_upd"][:, 0], out["p_upd"][:, 0, 0]], 1)


def trajectories(spark, model, seeds, steps):
    rows = simulate_for(spark.createDataFrame([(s, s) for s in seeds], "series bigint, seed bigint"), model, steps).orderBy("series", "k").toPandas()
    return {s: np.array([[x[0], y[0]] for x, y in zip(g.x, g.y, strict=True)]) for s, g in rows.groupby("series")}


@pytest.mark.parametrize("kind", ["b", "qy"])
def test_small_grid_by_brute_force(spark, kind):
    seeds, steps = (0, 5), 40
    make, values = (catalogue.back_action, (0.0, 2.0)) if kind == "b" else (catalogue.multiplicative_noise, (0.01, 0.3))
    got = {(r["value"], r["method"], r["seed"]): r for r in catalogue.runs(spark, make, values, seeds, steps).collect()}
    assert len(got) == 2 * 3 * 2 and not any(r["failed"] for r in got.values())
    for v in values:
        model = make(v)[0]
        for seed, z in trajectories(spark, model, seeds, steps).items():
            x, y = z[:, 0], z[:, 1]
            if kind == "b":
                expected = {"epkf": scalar(y, informed(v)), "naive": scalar(y, naive), "upkf": folded(model, "upkf", y)}
            else:
                expected = {"epkf": folded(model, "epkf", y), "upkf": folded(model, "upkf", y), "ukf_aug": folded(models.create("model_x1_y1_multiplicative_augmented", q_y=v), "ukf", y)}
            for method, est in expected.items():
                e, r = x - est[:, 0], got[v, method, seed]
                assert np.allclose([r["mse"], r["mae"], r["nees"]], [(e * e).mean(), np.abs(e).mean(), (e * e / est[:, 1]).mean()]), (v, method, seed)


def test_a_seed_that_fails_counts_for_no_filter(spark):
    rows = [(1.0, m, s, 2.0 + s, 0.0, 1.0, None, m == "a" and s == 2) for m in ("a", "b") for s in range(3)]
    out = catalogue.over_runs(spark.createDataFrame(rows, "value double, method string, seed bigint, mse double, mae double, nees double, nis double, failed boolean")).collect()
    assert sorted((r["method"], r["n"], r["mse_mean"], r["mse_std"]) for r in out) == [("a", 2, 2.5, 0.5), ("b", 2, 2.5, 0.5)]


def test_queries_hold_the_whole_grid(spark, tables):
    one = catalogue.QUERIES["shared_trajectory"](spark, tables).toPandas()
    assert sorted(one.method) == ["epkf", "ppf", "upkf"] and one.nees.notna().all() and one.set_index("method").nis.notna().to_dict() == {"epkf": True, "upkf": True, "ppf": False}
    assert (len(catalogue.B_GRID), len(catalogue.Q_GRID), len(catalogue.GRID_SEEDS), catalogue.GRID_STEPS, catalogue.GRID_PARTICLES) == (10, 8, 30, 1000, 500)


def test_all_values_in_one_plan_equal_each_alone(spark):
    """Particle filters too: their draws depend on the series, not on what else is in the plan."""
    steps, seeds = 30, (1, 4)
    make = catalogue.three_filters
    got = {(r["value"], r["method"], r["seed"]): r["mse"] for r in catalogue.runs(spark, make, (0.0, 1.0), seeds, steps).collect()}
    for value in (0.0, 1.0):
        model, entrants = make(value)
        rows = as_observations(simulate_for(spark.createDataFrame([(s, s) for s in seeds], "series bigint, seed bigint"), model, steps))
        for name, believed, method, options in entrants:
            alone = metrics.errors(filter_series(rows, believed, method, on_error="skip", **options), ["series"]).collect()
            assert len(alone) == 2
            for r in alone:
                assert np.isclose(r["mse"], got[value, name, r["series"]]), (value, name)


def test_linear_filters_agree(spark, tables):
    rows = catalogue.QUERIES["linear_three_ways"](spark, tables).toPandas()
    assert sorted(rows.method) == ["epkf", "pkf", "upkf"] and np.allclose(rows.mse, rows.mse.iloc[0], rtol=1e-4) and not rows.failed.any()


def test_more_particles_are_no_worse(spark, tables):
    rows = catalogue.QUERIES["particle_sweep"](spark, tables).toPandas().set_index("method")
    assert len(rows) == 19 and rows.mse.notna().all() and rows.nis.isna().all()
    assert rows.mse["pf_1000"] < 1.1 * rows.mse["pf_50"] and rows.mse["ppf_1000"] < 1.1 * rows.mse["ppf_50"]


def test_tables_of_models_are_checked(spark):
    keys = spark.createDataFrame([(0.0, 1, 1)], "value double, series bigint, seed bigint")
    one, two = models.create("model_x1_y1_pairwise"), models.create("model_x2_y1_pairwise")
    for chosen, steps in (({0.0: one, 1.0: two}, 5), ({0.0: models.create("model_x1_y1_augmented")}, 5), ({0.0: one}, 0)):
        with pytest.raises(ParamError):
            simulate_each(keys, chosen, steps)
    with pytest.raises(Exception, match="no model for 0.0"):
        simulate_each(keys, {1.0: one}, 5).collect()


def test_unscented_parameters_are_options():
    model = models.create("model_x1_y1_pairwise")
    usual, wide = kernels.build("upkf", model), kernels.build("upkf", model, alpha=1.0, kappa=1.0)
    assert np.abs(wide.unit).max() > np.abs(usual.unit).max()
    assert np.allclose(kernels.build("upkf", model, alpha=sigma.ALPHA, beta=sigma.BETA, kappa=sigma.KAPPA).unit, usual.unit)

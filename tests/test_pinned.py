"""Noise, priors and one step of every model pinned to numbers; the augmented unscented filter by a plain one."""

import json
from pathlib import Path

import numpy as np
import pytest

from tidefold.errors import ParamError
from tidefold.functions import covariances
from tidefold.operators import kernels
from tidefold.plans import comparisons, models

PINNED = json.loads((Path(__file__).parent / "pinned_models.json").read_text())


def figures(m):
    """A model's covariances, and where g takes one point with noise and without."""
    z, v = np.linspace(0.3, 0.9, m.dim), np.linspace(-0.2, 0.1, m.dim)
    return {"noise": m.noise.ravel().tolist(), "mean": m.mean.tolist(), "prior": m.prior.ravel().tolist(), "step": m.g_numpy(z[None], v[None])[0].tolist(), "still": m.g_numpy(z[None], 0 * v[None])[0].tolist()}


@pytest.mark.parametrize("name", models.names())
def test_models_stay_as_they_are(name):
    now = figures(models.create(name))
    assert set(PINNED) == set(models.names())
    for what, want in PINNED[name].items():
        assert np.allclose(now[what], want, rtol=1e-12, atol=1e-14), (name, what)


def test_steps_by_hand():
    """Equations written out once more, at the pinned point."""
    a, b = np.linspace(0.3, 0.9, 2)
    t, u = np.linspace(-0.2, 0.1, 2)
    want = {
        "model_x1_y1_pairwise_param": [0.5 * a + 3 * np.tanh(b) + t, 0.4 * b + 2 * np.sin(a / 20) + u],
        "model_x1_y1_multiplicative": [0.5 * a + 3 * np.tanh(b) + t, 0.4 * b + 2 * np.sin(a / 20) + (1 + a * a) * u],
        "model_x1_y1_Cubique_classic": [(x := 0.9 * a - 0.6 * a**3 + t), x + u],
        "model_x1_y1_Sinus_classic": [(x := 0.05 * a + 2 * np.sin(a) + t), 1.5 * np.sin(x) + u],
        "model_x1_y1_ExpSaturant_classic": [(x := 0.5 * a + 2 * (1 - np.exp(-0.1 * a)) + t), np.log(1 + max(abs(x), 1e-6)) + u],
        "model_x1_y1_Gordon_classic": [(x := 0.5 * a + 25 * a / (1 + a * a) + 8 * np.cos(1.2) + t), 0.05 * x * x + u],
        "model_x1_y1_markov_naive": [(x := 0.5 * a + t), 2 * np.sin(x / 20) + u],
        "model_x1_y1_AQ_pairwise": [0.95 * a - 0.5 * b + t, 0.3 * a + 0.85 * b + u],
        "model_x1_y1_AQ_classic": [(x := 0.8 * a + 0.25 * t), 0.4 * x + 0.35 * u],
    }
    for name, step in want.items():
        assert np.allclose(PINNED[name]["step"], step), name


def test_covariances_are_fixed_or_asked_for():
    with pytest.raises(ParamError):
        covariances.model_covariances(1, 1, 0.1234)
    noise, mean, prior = covariances.model_covariances(2, 1, 0.3, seed=4)
    assert np.abs(noise).max() == pytest.approx(0.3) and len(mean) == 3 and np.linalg.eigvalsh(prior)[0] > 0
    assert np.allclose(noise, covariances.model_covariances(2, 1, 0.3, seed=4)[0])


def plain_ukf(model, y):
    """Sigma points of Wan and van der Merwe, of the state alone, written out."""
    n = model.dim_x
    alpha, beta, kappa = kernels.sigma.ALPHA, kernels.sigma.BETA, kernels.sigma.KAPPA
    lam = alpha**2 * (n + kappa) - n
    wm = np.full(2 * n + 1, 1 / (2 * (n + lam)))
    wm[0] = lam / (n + lam)
    wc = wm.copy()
    wc[0] += 1 - alpha**2 + beta
    k = model.dim_x
    gain = model.prior[:k, k:] @ np.linalg.pinv(model.prior[k:, k:])
    x, p = model.mean[:k] + gain @ (y[0] - model.mean[k:]), model.prior[:k, :k] - gain @ model.prior[:k, k:].T

    def spread(x, p):
        root = kernels.factor(p[None])[0] * np.sqrt(n + lam)
        return np.vstack([x, *(x + root[:, i] for i in range(n)), *(x - root[:, i] for i in range(n))])

    out = [x]
    for one in y[1:]:
        moved = model.f_numpy(spread(x, p))
        mean = wm @ moved
        pxx = (wc * (moved - mean).T) @ (moved - mean) + model.noise[:k, :k]
        again = spread(mean, (pxx + pxx.T) / 2)
        seen = model.h_numpy(again)
        ym = wm @ seen
        pyy = (wc * (seen - ym).T) @ (seen - ym) + model.noise[k:, k:]
        pxy = (wc * (again - mean).T) @ (seen - ym)
        g = pxy @ np.linalg.inv(pyy)
        x, p = mean + g @ (one - ym), pxx - g @ pyy @ g.T
        out.append(x)
    return np.array(out)


def test_augmented_filters(spark, tables):
    got = {r["method"]: r for r in comparisons.augmented_filters(spark, tables).collect()}
    part = comparisons.QUERIES["bar_state_part"](spark, tables).collect()
    assert got["epkf"]["mse"] == pytest.approx(sum(r["mse"] * r["n"] for r in part) / sum(r["n"] for r in part), abs=1e-5)
    rows = comparisons.hour_rows(spark, tables, True).orderBy("series", "ord_0").collect()
    errors = []
    for s in sorted({r["series"] for r in rows}):
        own = [r for r in rows if r["series"] == s]
        x = plain_ukf(comparisons.WIDE_MODEL, np.array([r["y"] for r in own]))
        errors += [(r["x_true"][0] - v[0]) ** 2 for r, v in zip(own, x, strict=True)]
    assert got["ukf"]["mse"] == pytest.approx(np.mean(errors), rel=1e-3) and got["ukf"]["n"] == len(rows)

"""Learned dynamics: gradients and slopes against differences, the equations against matrices, and what is learned against what made the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.errors import ParamError
from tidefold.functions.algebra import NUMPY
from tidefold.operators import learned, metrics, prepare, simulate
from tidefold.operators.filters import filter_series, observations
from tidefold.operators.learned import Network
from tidefold.plans import models


def network(seed=0, dim=3, hidden=(5, 4)):
    rng = np.random.default_rng(seed)
    return Network.fresh(dim, hidden, rng.normal(size=dim), rng.uniform(0.5, 2, dim), seed)


def test_gradient_equals_differences():
    net, rng = network(), np.random.default_rng(1)
    a, b = rng.normal(size=(7, 3)), rng.normal(size=(7, 3))
    g, loss = net.gradient(a, b)
    flat = net.flat()
    for i in range(len(flat)):
        near = []
        for sign in (1, -1):
            moved = flat.copy()
            moved[i] += sign * 1e-6
            near.append(net.with_flat(moved).gradient(a, b)[1])
        assert abs((near[0] - near[1]) / 2e-6 - g[i]) < 1e-5 * max(1, abs(g[i]))
    assert loss == pytest.approx(((net._through(a)[-1] - b) ** 2).sum())


def test_slopes_and_equations(spark):
    net, rng = network(2), np.random.default_rng(3)
    z = rng.normal(size=(6, 3))
    model = learned.model_of(net, np.eye(3), np.zeros(3), np.eye(3), 2)
    value, by_z, by_v = model.jacobians_numpy(z)
    assert np.allclose(value, np.stack(net.equations(NUMPY, list(z.T)), 1)) and np.allclose(by_v, np.eye(3))
    for j in range(3):
        step = np.zeros(3)
        step[j] = 1e-6
        assert np.allclose((net.predict(z + step) - net.predict(z - step)) / 2e-6, by_z[:, :, j], atol=1e-6)
    plain = super(learned.LearnedModel, model).jacobians_numpy(z)
    assert all(np.allclose(p, q) for p, q in zip(plain, (value, by_z, by_v), strict=True))
    df = spark.createDataFrame([tuple(map(float, r)) for r in z], "a double, b double, c double")
    got = df.select(*[c.alias(f"o{i}") for i, c in enumerate(model.g_columns([F.col("a"), F.col("b"), F.col("c")]))]).toPandas().to_numpy()
    assert np.allclose(got, value)


def trained_by_hand(pairs, net, epochs, rate):
    a, b = ((pairs[:, k : k + 2] - net.mean) / net.std for k in (0, 2))
    w, m, v = net.flat(), 0.0, 0.0
    for t in range(1, epochs + 1):
        g = net.with_flat(w).gradient(a, b)[0] / a.size
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net.with_flat(w)


@pytest.fixture(scope="module")
def pairs(spark):
    rows = simulate.simulate(spark, models.pairwise_param(b=1.0), 150, 6).select("series", "k", F.col("x")[0].alias("x"), F.col("y")[0].alias("y"))
    return prepare.consecutive_pairs(rows, "series", "k", ["x", "y"]).cache()


def test_training_equals_one_machine(spark, pairs, monkeypatch):
    rows = np.array([tuple(r) for r in pairs.select("x", "y", "next_x", "next_y").collect()])
    start = Network.fresh(2, (8,), rows[:, :2].mean(0), rows[:, :2].std(0) + 1e-8, 5)
    want = trained_by_hand(rows, start, 4, 0.01).flat()
    assert np.allclose(learned.fit(pairs, ["x", "y"], hidden=(8,), epochs=4, rate=0.01, seed=5).flat(), want, atol=1e-9)
    # Sums of few tasks at a time give the same.
    monkeypatch.setattr(learned, "FAN", 2)
    assert np.allclose(learned.fit(pairs.repartition(5), ["x", "y"], hidden=(8,), epochs=2, rate=0.01, seed=5).flat(), trained_by_hand(rows, start, 2, 0.01).flat(), atol=1e-9)


def test_residual_noise_and_slices(spark, pairs):
    heard = []
    net = learned.fit(pairs, ["x", "y"], hidden=(6,), epochs=10, rate=0.02, slices=3, told=lambda e, loss: heard.append((e, loss)))
    rows = np.array([tuple(r) for r in pairs.select("x", "y", "next_x", "next_y").collect()])
    assert np.allclose(learned.residual_noise(pairs, ["x", "y"], net), np.cov(rows[:, 2:] - net.predict(rows[:, :2]), rowvar=False))
    assert heard[0][0] == 10 and heard[0][1] < 1.0


def test_learned_filter_is_nearly_as_good_as_the_true_model(spark, pairs):
    """It beats the linear regression of x on y, and single shots, on rows it hasn't seen."""
    true = models.pairwise_param(b=1.0)
    model = learned.learn(pairs, ["x", "y"], hidden=(16, 16), epochs=60, rate=0.02)
    keys = spark.createDataFrame([(100 + i, 77) for i in range(4)], "series bigint, seed bigint")
    rows = simulate.as_observations(simulate.simulate_for(keys, true, 150)).cache()
    mse = lambda m: metrics.errors(filter_series(rows, m, "epkf", output=("x_upd",))).first()["mse"]
    line = prepare.linear_regression(pairs).first()
    linear = rows.select(F.avg(F.pow(F.col("x_true")[0] - line["slope"] * F.col("y")[0] - line["intercept"], 2))).first()[0]
    single = rows.select(F.avg(F.pow(F.col("x_true")[0] - F.col("y")[0], 2))).first()[0]
    assert abs(mse(model) / mse(true) - 1) < 0.05 and mse(model) < 0.6 * min(linear, single)


def test_nothing_to_learn_from(spark, pairs):
    with pytest.raises(ParamError):
        learned.fit(pairs.where("false"), ["x", "y"])
    with pytest.raises(ParamError):
        learned.fit(pairs, ["x", "y"], epochs=0)


def test_unscented_and_particle_filters_take_it(spark, pairs):
    model = learned.learn(pairs, ["x", "y"], hidden=(4,), epochs=2, rate=0.02)
    rows = observations(pairs.where("series < 2"), "series", ["k"], ["y"], ["x"])
    for method, options in (("upkf", {}), ("ppf", {"n_particles": 50})):
        out = filter_series(rows, model, method, output=("x_upd",), **options)
        assert out.where(F.isnan(F.col("x_upd")[0])).count() == 0 and out.count() == rows.count()

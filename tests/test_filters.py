import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.errors import FilterError, InvertibilityError, ParamError
from tidefold.operators import kernels, metrics, native, sigma
from tidefold.operators.filters import Fold, filter_series, observations
from tidefold.operators.simulate import as_observations, simulate
from tidefold.plans import models

LINEAR = models.names("linear")


def trajectory(model, n=60, seed=42):
    rng = np.random.default_rng(seed)
    z = rng.multivariate_normal(model.mean, model.prior)
    out = [z]
    for _ in range(n):
        z = model.g_numpy(z[None], rng.multivariate_normal(np.zeros(model.dim), model.noise)[None])[0]
        out.append(z)
    return np.array(out)


def run(model, method, y, **options):
    keys = np.empty(len(y), object)
    keys[:] = [0] * len(y)
    return Fold(kernels.build(method, model, **options), None, "raise").run(keys, y)[3]


@pytest.mark.parametrize("name", LINEAR)
def test_filters_agree_on_linear_models(name):
    m = models.create(name)
    y = trajectory(m)[:, m.dim_x :]
    base = run(m, "pkf", y)
    for method, options in [("epkf", {})] + [("upkf", {"sigma_set": s}) for s in sigma.names()] + ([] if m.pairwise else [("ukf", {})]):
        other = run(m, method, y, **options)
        tolerance = 1e-5 if m.form == "augmented" else 1e-8
        assert np.allclose(base["x_upd"], other["x_upd"], atol=tolerance), method


def test_scalar_filter_by_hand():
    m = models.pairwise_param()
    y = trajectory(m)[:, 1]
    out = run(m, "epkf", y[:, None])
    x, p = 0.0, 0.1
    for k in range(1, len(y)):
        xp, yp, a, c = 0.5 * x + 3 * np.tanh(y[k - 1]), 0.4 * y[k - 1] + 2 * np.sin(x / 20), 0.5, 0.1 * np.cos(x / 20)
        pxx, pxy, pyy = a * a * p + 0.04, a * c * p, c * c * p + 0.025
        g = pxy / pyy
        x, p = xp + g * (y[k] - yp), pxx - g * pxy
        assert np.isclose(out["x_upd"][k, 0], x) and np.isclose(out["p_upd"][k, 0, 0], p)


@pytest.mark.parametrize("method", ["pkf", "epkf", "upkf"])
def test_batches_give_the_same(method):
    m = models.create("model_x2_y2_AQ_pairwise")
    parts = [trajectory(m, n, s)[:, 2:] for n, s in ((30, 1), (5, 2), (44, 3), (1, 4))]
    keys = np.empty(sum(map(len, parts)), object)
    keys[:] = [i for i, p in enumerate(parts) for _ in p]
    y = np.concatenate(parts)
    whole = Fold(kernels.build(method, m), None, "raise").run(keys, y)[3]["x_upd"]
    for width in (1, 7, 33):
        fold = Fold(kernels.build(method, m), None, "raise")
        pieces = [fold.run(keys[a : a + width], y[a : a + width])[3]["x_upd"] for a in range(0, len(y), width)]
        assert np.allclose(np.concatenate(pieces), whole)


@pytest.mark.parametrize(("method", "model", "error"), [("pf", "model_x1_y1_pairwise", ParamError), ("ukf", "model_x1_y1_pairwise", FilterError), ("pkf", "model_x1_y1_pairwise", FilterError), ("pf", "model_x1_y1_augmented", InvertibilityError), ("ppf", "model_x1_y1_AQ_augmented", InvertibilityError), ("upkf", "model_x1_y1_pairwise", None), ("none", "model_x1_y1_pairwise", ParamError)])
def test_support(method, model, error):
    if error is None:
        assert kernels.build(method, models.create(model)).model.pairwise
        return
    with pytest.raises(error):
        kernels.build(method, models.create(model))


def test_options_are_checked():
    m = models.pairwise_param()
    for options in ({"sigma_set": "none"}, {"n_particles": 5}):
        with pytest.raises(ParamError):
            kernels.build("upkf", m, **options)
    with pytest.raises(ParamError):
        kernels.build("ppf", m, resampling="none")


def test_long_filter_beats_zero_and_is_calibrated():
    for name in ("model_x1_y1_AQ_pairwise", "model_x2_y2_AQ_pairwise"):
        m = models.create(name)
        z = trajectory(m, 500)
        k = m.dim_x
        out = run(m, "pkf", z[:, k:])
        assert ((z[:, :k] - out["x_upd"]) ** 2).mean() < (z[:, :k] ** 2).mean()
        e = z[1:, :k] - out["x_upd"][1:]
        nees = np.einsum("ni,nij,nj->n", e, np.linalg.inv(out["p_upd"][1:]), e).mean() / k
        assert 0.5 < nees < 2.0


def test_particles_come_near_the_extended_filter():
    m = models.pairwise_param()
    z = trajectory(m, 300)
    mse = lambda o: ((z[:, :1] - o["x_upd"]) ** 2).mean()
    assert mse(run(m, "ppf", z[:, 1:], n_particles=300)) < 1.3 * mse(run(m, "epkf", z[:, 1:]))


def test_resampling():
    w = np.full((3, 20), 1 / 20)
    u = np.random.default_rng(0).uniform(size=(3, 20))
    for how in kernels.RESAMPLERS:
        chosen = kernels.resample(w, how, u)
        assert chosen.shape == (3, 20) and chosen.min() >= 0 and chosen.max() < 20
    skewed = np.array([[0.0, 1.0, 0.0]])
    for how in kernels.RESAMPLERS:
        assert set(kernels.resample(skewed, how, u[:1, :3]).ravel()) == {1}
    with pytest.raises(ParamError):
        kernels.resample(w, "none", u)


def test_weights():
    w, lost = kernels.normalised_weights(np.full((1, 20), -np.inf))
    assert np.allclose(w, 1 / 20) and lost.all()
    w, lost = kernels.normalised_weights(np.array([[-1.0, np.nan, -2.0]]))
    assert np.isclose(w.sum(), 1) and w[0, 1] == 0 and not lost.any()


@pytest.mark.parametrize("key", sigma.names())
@pytest.mark.parametrize("n", [1, 2, 3])
def test_sigma_moments(key, n):
    unit, wm, _ = sigma.points(key, n)
    assert np.isclose(wm.sum(), 1) and np.allclose(wm @ unit, 0) and np.allclose((unit.T * wm) @ unit, np.eye(n))


def test_sigma_registry():
    with pytest.raises(ParamError):
        sigma.register("cpkf", lambda n, a, b, k: None)
    with pytest.raises(ParamError):
        sigma.points("none", 2)


def test_series_by_spark_equal_one_fold(spark):
    m = models.pairwise_param()
    t = simulate(spark, m, 40, 9)
    out = filter_series(as_observations(t), m, "epkf").orderBy("series", "k").toPandas()
    assert len(out) == 9 * 41 and out.groupby("series").k.apply(list).map(lambda k: k == list(range(41))).all()
    y = np.array(t.where("series = 4").orderBy("k").toPandas().y.tolist())
    assert np.allclose(np.array(out[out.series == 4].x_upd.tolist()), run(m, "epkf", y)["x_upd"])
    folded = native.native_filter(as_observations(t), m).orderBy("series", "k").toPandas()
    assert np.allclose(folded.x_upd, [x[0] for x in out.x_upd])


def test_limit_and_errors(spark):
    m = models.pairwise_param()
    rows = as_observations(simulate(spark, m, 20, 2))
    assert filter_series(rows, m, limit=5).count() == 12
    for bad in (0, -1, 2.5):
        with pytest.raises(ParamError):
            filter_series(rows, m, limit=bad)
    with pytest.raises(ParamError):
        filter_series(rows, m, output=("none",))


def test_missing_observations(spark):
    rows = observations(spark.createDataFrame([(1, 0, 0.5), (1, 1, None), (1, 2, 0.7)], "s int, k int, v double"), "s", ["k"], ["v"])
    assert filter_series(rows, models.pairwise_param(), missing="drop").count() == 2
    with pytest.raises(Exception, match="null"):
        filter_series(rows, models.pairwise_param()).count()


def test_failing_series_is_raised_or_skipped(spark):
    m = models.lotka_volterra()
    rows = observations(spark.createDataFrame([(1, 0, 20.0), (1, 1, 1e200), (1, 2, 1.0), (1, 3, 1.0), (2, 0, 20.0), (2, 1, 21.0)], "s int, k int, v double"), "s", ["k"], ["v"])
    out = filter_series(rows, m, on_error="skip", output=("x_upd",)).toPandas()
    assert (out[out.series == 2].status == 0).all() and (out[out.series == 1].status > 0).any()
    with pytest.raises(Exception, match="Error"):
        filter_series(rows, m, output=("x_upd",)).count()


def test_empty_input(spark):
    rows = observations(spark.createDataFrame([], "s int, k int, v double"), "s", ["k"], ["v"])
    assert filter_series(rows, models.pairwise_param()).count() == 0


def test_simulation_doesnt_depend_on_partitions(spark):
    m = models.create("model_x2_y1_pairwise")
    one = simulate(spark, m, 30, 5).orderBy("series", "k").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    two = simulate(spark, m, 30, 5).orderBy("series", "k").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == two and len(one) == 5 * 31


def test_envelope_policy(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 4.0), (1, 1, 1.0, -1e-9)], "series int, k int, v double, p double")
    out = metrics.envelope(df, F.col("v"), F.col("p"), ["series"]).orderBy("k").collect()
    assert (out[0]["lo"], out[0]["hi"], out[1]["lo"]) == (-3.0, 5.0, 1.0)
    bad = spark.createDataFrame([(1, 0, 1.0, 4.0), (1, 1, 1.0, -0.5)], "series int, k int, v double, p double")
    with pytest.raises(Exception, match="negative"):
        metrics.envelope(bad, F.col("v"), F.col("p"), ["series"]).collect()


def test_window_falls_back_to_all(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    assert (metrics.window_of(df, 2, 5).count(), metrics.window_of(df, 50, 60).count(), metrics.window_of(df, None, None).count()) == (3, 10, 10)
    with pytest.raises(ParamError):
        metrics.window_of(df, 2, None)

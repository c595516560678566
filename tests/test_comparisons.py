"""Scores of pairs, first offenders and contests against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.errors import ParamError
from tidefold.operators import metrics, prepare
from tidefold.operators.filters import filter_series
from tidefold.operators.metrics import Pair
from tidefold.plans import comparisons, models


def test_pairs_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(90):
        a = rng.normal(size=(2, 2))
        truth = None if i % 17 == 0 else rng.normal(size=2).tolist()
        rows.append((f"s{i % 4}" if i % 4 else None, truth, rng.normal(size=2).tolist(), (a @ a.T + np.eye(2)).tolist(), [float(rng.normal())], [[float(rng.uniform(1, 2))]]))
    df = spark.createDataFrame(rows, "series string, t array<double>, e array<double>, p array<array<double>>, i array<double>, s array<array<double>>").repartition(3)
    got = {(r["pair"], r["series"], r["component"], r["n"]): r for r in metrics.compare(df, [Pair("all", "t", "e", "p", "i", "s", dim=2), Pair("plain", "e", "t")]).collect()}
    seen = 0
    fine = [r for r in rows if r[1] is not None]
    for pair, sign in (("all", 1), ("plain", -1)):
        for series in ("every", None, "s1", "s2", "s3"):
            some = [r for r in fine if series == "every" or r[0] == series]
            error = sign * np.array([np.subtract(r[1], r[2]) for r in some])
            nees = np.mean([e @ np.linalg.inv(r[3]) @ e for e, r in zip(error, some, strict=True)])
            nis = np.mean([r[4][0] ** 2 / r[5][0][0] for r in some])
            for component in (None, 0, 1):
                e = error if component is None else error[:, component : component + 1]
                key = (pair, None if series == "every" else series, component, e.size)
                r = got[key]
                seen += 1
                assert np.allclose([r["mse"], r["mae"], r["rmse"]], [(e**2).mean(), np.abs(e).mean(), np.sqrt((e**2).mean())])
                if pair == "all" and component is None:
                    assert np.allclose([r["nees"], r["nis"]], [nees, nis])
                else:
                    assert r["nees"] is None and r["nis"] is None
    assert seen == 30 and metrics.compare(df, [Pair("all", "t", "e"), Pair("plain", "e", "t")]).count() == 30
    with pytest.raises(ParamError):
        metrics.compare(df, [Pair("a", "t", "e"), Pair("a", "e", "t")])


def test_first_offenders(spark):
    rng = np.random.default_rng(1)
    rows = [("big", i, float(v)) for i, v in enumerate(rng.permutation(np.concatenate((-rng.uniform(1, 2, 400), rng.uniform(1, 9, 400)))))]
    rows += [("fine", 0, 5.0), ("fine", 1, -4e-6), ("few", 3, -1.0), ("few", 3, -1.0), ("few", 1, -2.0), (None, 7, -3.0), ("null", 1, None), ("tiny", 1, -1e-13)]
    got = {r["g"]: r for r in metrics.first_offenders(spark.createDataFrame(rows, "g string, at int, v double").repartition(4), F.col("v"), ["g"], "at").collect()}
    assert set(got) == {"big", "few", None}
    assert got["big"]["places"] == sorted(i for g, i, v in rows if g == "big" and v < 0)[:5] and got["big"]["n_bad"] == 400
    assert got["few"]["places"] == [1, 3, 3] and got["few"]["worst"] == 2.0 and got[None]["places"] == [7]


def test_envelope_names_rows(spark):
    rows = [("a", i, 1.0, 4.0 if i not in (2, 5, 6, 7, 8, 9) else -0.5) for i in range(12)] + [("b", 0, 0.0, 1.0), ("b", 1, 1.0, -1e-7)]
    df = spark.createDataFrame(rows, "series string, k int, x double, v double")
    good = {r["k"]: r for r in metrics.envelope(df.where("series = 'b'"), F.col("x"), F.col("v"), ["series"]).collect()}
    assert set(good[0].asDict()) == {"series", "k", "x", "v", "value", "lo", "hi"} and good[0]["hi"] == 2.0 and good[1]["lo"] == 1.0
    with pytest.raises(Exception, match="series=a.*first k 2, 5, 6, 7, 8$|series=a.*first k 2, 5, 6, 7, 8[^,]"):
        metrics.envelope(df, F.col("x"), F.col("v"), ["series"]).collect()
    with pytest.raises(Exception, match="strongly negative"):
        metrics.envelope(df, F.col("x"), F.col("v"), ["series"], named=0).collect()


def test_four_components_over_the_table(spark, tables):
    model = models.create("model_x2_y2_AQ_augmented")
    got = {(r["series"], r["k"]): r["nees"] for r in comparisons.QUERIES["bar_nees_4d"](spark, tables).collect()}
    steps = filter_series(comparisons.body_rows(spark, tables, True), model, "pkf", output=("x_upd", "p_upd")).collect()
    assert len(steps) == len(got)
    for r in steps:
        e, p = np.subtract(r["x_true"], r["x_upd"]), np.array(r["p_upd"])
        want = e @ (np.linalg.inv(p) if np.linalg.det(p) != 0 else np.linalg.pinv(p)) @ e
        assert got[r["series"], r["k"]] == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_contest_of_learned_filters(spark, tables):
    rows = {r["method"]: r for r in comparisons.sv_comparison_learned(spark, tables).collect()}
    assert set(rows) == {"epkf", "upkf", "ppf", "single_shot", "persistence", "training_mean"} and len({r["n"] for r in rows.values()}) == 1
    assert all((rows[m]["nees"] is None) == (m not in ("epkf", "upkf", "ppf")) and (rows[m]["nis"] is None) == (m not in ("epkf", "upkf")) for m in rows)
    assert rows["epkf"]["mse"] < min(rows["single_shot"]["mse"], rows["persistence"]["mse"])


def test_bars_of_hours_and_days_agree(spark, tables):
    events = spark.read.parquet(f"{tables}/events.parquet")
    take = lambda f, *a: sorted((r["series"], str(r["day"])[:10], r["open"], r["high"], r["low"], r["close"]) for r in f(events, F.col("event_type"), *a, "ts", "event_id", F.col("value")).collect())
    assert take(prepare.daily_bars) == take(prepare.time_bars, "day")

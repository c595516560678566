"""Runs as objects, checks of models, the command line on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.__main__ import main
from tidefold.errors import FilterError, ParamError, TidefoldError
from tidefold.operators import metrics
from tidefold.operators.filters import filter_series, observations
from tidefold.plans import models
from tidefold.runs import Run, RunOptions


@pytest.mark.parametrize("method", ["epkf", "ppf"])
def test_scores_equal_those_of_the_operators(spark, method):
    settings = {"n_particles": 40} if method == "ppf" else {}
    run = Run(method, "model_x1_y1_pairwise_param", steps=40, series=3, settings=settings, parameters={"b": 1.0})
    steps = run.history(spark)
    assert run.history(spark) is steps and steps.count() == 123
    got = {r["series"]: r for r in run.scores(spark, ["series"]).collect()}
    want = metrics.errors(filter_series(run.observations(spark), run.model, method, **settings), ["series"]).collect()
    assert all(got[r["series"]]["mse"] == pytest.approx(r["mse"]) for r in want) and len(got) == 3
    assert (got[0]["nis"] is None) == (method == "ppf") and got[0]["nees"] > 0
    assert run.scores(spark).first()["n"] == 123
    assert {r["k"] for r in run.last(spark).collect()} == {40} and run.window(spark, 5, 9).count() == 12 and run.window(spark, 100, 200).count() == 123
    rows = run.plot_rows(spark).collect()
    assert len(rows) == 123 and all(r["lo"] <= r["value"] <= r["hi"] for r in rows)
    assert method in run.summary() and ("n_degenerate" in steps.columns) == (method == "ppf")
    run.clear()
    assert run.history(spark) is not steps


def test_history_stays_where_asked(spark, tmp_path):
    run = Run("pkf", "model_x2_y2_AQ_pairwise", steps=10, options=RunOptions(save_history=True, base_dir=str(tmp_path / "h")))
    assert run.history(spark).count() == 11 and (tmp_path / "h" / "model=model_x2_y2_AQ_pairwise" / "method=pkf").is_dir()
    assert run.plot_rows(spark).count() == 22 and "stable" in run.summary()


def test_rows_of_a_table(spark, tables):
    events = spark.read.parquet(f"{tables}/events.parquet")
    rows = observations(events, "user_id", ["ts", "event_id"], [(F.col("value") - 20) / 20])
    run = Run("upkf", models.pairwise_param(), data=rows, settings={"sigma_set": "cpkf"})
    assert run.history(spark).count() == events.count() and run.scores(spark).first()["n"] == 0


@pytest.mark.parametrize(
    "wrong",
    [
        {"method": "none"}, {"model": "none"}, {"steps": 0}, {"steps": None}, {"data": "a.csv"}, {"series": 0}, {"settings": {"sigma_set": "cpkf"}}, {"method": "upkf", "settings": {"sigma_set": "none"}},
        {"method": "ppf", "settings": {"n_particles": 0}}, {"method": "pf"}, {"method": "ukf"}, {"method": "pkf"}, {"model": models.pairwise_param(), "parameters": {"b": 1.0}},
    ],
)
def test_what_is_wrong_is_told_before_anything_runs(wrong):
    with pytest.raises((ParamError, FilterError)):
        Run(**({"method": "epkf", "model": "model_x1_y1_pairwise", "steps": 5} | wrong))


def test_options_are_checked():
    for wrong in ({"verbose": 3}, {"save_history": True}, {"on_error": "stop"}):
        with pytest.raises(ParamError):
            RunOptions(**wrong)


@pytest.mark.parametrize("name", models.names())
def test_every_model_holds_its_own_checks(name):
    m = models.create(name)
    assert m.with_(name="other").name == "other" and m.summary().startswith(name)
    n = m.dim
    bad = [{"noise": np.eye(n + 1)}, {"noise": -np.eye(n)}, {"prior": np.eye(n) + np.triu(np.ones((n, n)), 1)}, {"mean": np.zeros(n + 1)}, {"mean": np.full(n, np.nan)}, {"form": "other"}, {"dim_y": 0}]
    bad += [{"A": None}, {"A": 1.01 * np.eye(n)}] if m.linear else [{"A": np.eye(n)}]
    for change in bad:
        with pytest.raises(ParamError):
            m.with_(**change)


def test_command_line_as_latex(spark, capsys):
    assert main(["filter", "--model", "model_x1_y1_pairwise", "--method", "epkf", "--steps", "8", "--latex"], spark) == 0
    assert r"\begin{tabular}" in capsys.readouterr().out
    assert issubclass(ParamError, TidefoldError)

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.__main__ import main
from tidefold.errors import ParamError
from tidefold.operators import diagnostics
from tidefold.operators.filters import filter_series, observations
from tidefold.operators.simulate import as_observations, simulate, wide
from tidefold.plans import models
from tidefold.sources import files
from tidefold.streaming.filters import LATE, run_available, stream_filter


def test_csv_round_trip(spark, tmp_path):
    m = models.create("model_x2_y1_pairwise")
    t = wide(simulate(spark, m, 30), 2, 1).drop("series")
    files.write_csv(t.coalesce(1), str(tmp_path / "t.csv"))
    back = files.read_table(spark, str(tmp_path / "t.csv"))
    assert back.columns == ["k", "X0", "X1", "Y0"] and back.count() == 31
    rows = files.series_of(back, 2, 1, order=["k"])
    assert filter_series(rows, m, "upkf").count() == 31
    files.csv_to_parquet(spark, str(tmp_path / "t.csv"), str(tmp_path / "t.parquet"))
    assert files.read_table(spark, str(tmp_path / "t.parquet")).count() == 31


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_sniffed_delimiter(spark, tmp_path, sep):
    path = tmp_path / "a.txt"
    path.write_text("\n".join([sep.join(("X0", "Y0"))] + [sep.join((f"{i}.5", f"{i}.25")) for i in range(20)]))
    out = files.read_table(spark, str(path))
    assert out.columns == ["X0", "Y0"] and out.count() == 20


def test_prefixes():
    n = files.by_prefix(["t", "X0", "X1", "Y0", "True0"])
    assert (n.x, n.y, n.true, n.others, n.x_before_y) == (["X0", "X1"], ["Y0"], ["True0"], ["t"], True)
    assert not files.by_prefix(["Y0", "X0"]).x_before_y


def test_bad_files(spark, tmp_path):
    with pytest.raises(ParamError):
        files.read_table(spark, "a.xlsx")
    with pytest.raises(ParamError):
        files.series_of(spark.createDataFrame([(1.0, 2.0)], "X0 double, Y0 double"), 2, 1)


def test_encoding(spark, tmp_path):
    for name, text, raw in (("utf-8", "é", "é".encode()), ("latin-1", "é", "é".encode("latin-1")), ("utf-16", "é", "é".encode("utf-16"))):
        (tmp_path / name).write_bytes(raw)
        assert files.encoding_of(spark, str(tmp_path / name)) == name


def test_index_formats(spark):
    lines = spark.createDataFrame([("1951 1 a b c d e f 0.5 x",), ("1951 2 a b c d e f -99.9 x",), ("header",)], "value string")
    assert [tuple(r) for r in files.parse_index(lines).collect()] == [(1951, 1, 0.5)]
    block = ["title", "YEAR JAN", "1951 " + " ".join(["1.0"] * 11) + "-2.0", "1952 " + " ".join(["-999.9"] * 12), "YEAR second", "1953 " + " ".join(["3.0"] * 12)]
    got = files.parse_monthly_block(spark.createDataFrame(list(enumerate(block)), "place int, value string")).orderBy("month").collect()
    assert len(got) == 12 and got[-1]["value"] == -2.0 and {r["year"] for r in got} == {1951}


def test_steps_round_trip(spark, tmp_path):
    m = models.pairwise_param()
    steps = filter_series(as_observations(simulate(spark, m, 19)), m)
    files.save_steps(steps, str(tmp_path / "s"), m.name, "epkf")
    back = files.load_steps(spark, str(tmp_path / "s"))
    assert back.count() == 20 and back.agg(F.max("k")).first()[0] == 19


def test_diagnostics_of_any_size(spark):
    rows = [(1, [[2.0, 0.5], [0.5, 1.0]]), (2, [[1.0, 2.0], [2.0, 1.0]]), (3, [[1.0, 0.0], [0.0, 1e-11]]), (4, [[float("nan"), 0.0], [0.0, 1.0]]), (5, None)]
    df = spark.createDataFrame(rows, "id int, m array<array<double>>")
    got = {r["id"]: (r["is_ok"], r["is_valid"]) for r in diagnostics.matrix_report(df, "m").collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, True), 4: (False, False), 5: (False, False)}
    healed = diagnostics.matrix_report(diagnostics.regularise(df.where("id = 2"), "m"), "m").first()
    assert healed["is_valid"]
    inverse = {r["id"]: r["is_valid"] for r in diagnostics.matrix_report(spark.createDataFrame([(1, [[1.0, 2.0], [2.0, 4.0]]), (2, [[1.0, 2.0], [3.0, 4.0]])], df.schema), "m", "invertible").collect()}
    assert inverse == {1: False, 2: True}
    both = spark.createDataFrame([([[1.0]], [[1.0 + 1e-9]]), ([[1.0]], [[2.0]])], "a array<array<double>>, b array<array<double>>")
    assert [r["equal"] for r in diagnostics.same_matrices(both, "a", "b").collect()] == [True, False]


@pytest.mark.parametrize("chunks", [1, 2, 7])
@pytest.mark.parametrize("method", ["epkf", "ppf"])
def test_stream_equals_batch(spark, tmp_path, chunks, method):
    m = models.pairwise_param()
    options = {"n_particles": 50} if method == "ppf" else {}
    rows = simulate(spark, m, 20, 3).select("series", "k", F.col("y")[0].alias("v")).toPandas()
    for i, part in enumerate(np.array_split(rows.sort_values("k"), chunks)):
        path = str(tmp_path / "in" / f"{i}.parquet")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part.to_parquet(path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    live = spark.readStream.schema("series bigint, k bigint, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_available(stream_filter(observations(live, "series", ["k"], ["v"]), m, method, **options), str(tmp_path / "out"), str(tmp_path / "state")).toPandas()
    batch = filter_series(observations(spark.read.parquet(str(tmp_path / "in")), "series", ["k"], ["v"]), m, method, **options).toPandas()
    a, b = (d.sort_values(["series", "k"]) for d in (out, batch))
    assert len(a) == 63 and np.allclose([x[0] for x in a.x_upd], [x[0] for x in b.x_upd])


def test_late_rows_are_marked(spark, tmp_path):
    m = models.pairwise_param()
    for i, rows in enumerate(([(1, 0, 0.1), (1, 5, 0.2)], [(1, 3, 0.9), (1, 6, 0.3)])):
        path = str(tmp_path / f"{i}.parquet")
        spark.createDataFrame(rows, "series bigint, k bigint, v double").toPandas().to_parquet(path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    live = spark.readStream.schema("series bigint, k bigint, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*.parquet"))
    out = run_available(stream_filter(observations(live, "series", ["k"], ["v"]), m), str(tmp_path / "o"), str(tmp_path / "s")).toPandas()
    assert sorted(out.status) == [0, 0, 0, LATE] and sorted(out.k.dropna()) == [0, 1, 2]


@pytest.mark.parametrize("method", ["epkf", "upkf", "ppf"])
def test_command_line(spark, tmp_path, method, capsys):
    assert main(["filter", "--model", "model_x1_y1_pairwise", "--method", method, "--steps", "20", "--particles", "30"], spark) == 0
    assert "mse" in capsys.readouterr().out


def test_command_line_files(spark, tmp_path):
    out = str(tmp_path / "d.csv")
    assert main(["simulate", "--model", "model_x1_y1_AQ_classic", "--steps", "30", "--out", out], spark) == 0
    assert main(["filter", "--model", "model_x1_y1_AQ_classic", "--method", "pkf", "--data", out, "--out", str(tmp_path / "h")], spark) == 0
    config = tmp_path / "c.toml"
    config.write_text('steps = 10\nmodel = "model_x1_y1_pairwise"\nmethod = "epkf"\n')
    assert main(["--config", str(config), "filter"], spark) == 0


@pytest.mark.parametrize("argv", [["filter", "--model", "none", "--method", "pkf", "--steps", "5"], ["filter", "--model", "model_x1_y1_pairwise", "--method", "pf", "--steps", "5"], ["filter", "--model", "model_x1_y1_pairwise", "--method", "epkf"], ["simulate", "--model", "model_x1_y1_pairwise", "--steps", "0"]])
def test_command_line_errors(spark, argv):
    assert main(argv, spark) == 2


def test_models_are_listed(capsys):
    assert main(["models"]) == 0
    assert "model_x2_y2_augmented" in capsys.readouterr().out

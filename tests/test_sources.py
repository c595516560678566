"""Readers and writers of series: month tables, indices, bars with long headers, numeric text, splits, tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.errors import ParamError
from tidefold.operators import learned, prepare
from tidefold.sources import files

BLOCK = ["  title 1 2 3", "", "YEAR  JAN FEB", "1951 " + " ".join(["1.0"] * 11) + "-2.0", "1952 +1.5-999.9 3.0", " 1953  4.0 5.0-6.0 +7.0 8.5", "1953 9.0", "x 3 4", "1954.5 1 2", "YEAR again", "1960 3.0"]


def by_hand(lines):
    out, section = {}, 0
    for line in lines:
        if line.strip().startswith("YEAR"):
            section += 1
            continue
        numbers = re.findall(r"[-+]?\d+\.?\d*", line.strip())
        if section == 1 and numbers and re.fullmatch(r"[-+]?\d+", numbers[0]):
            out |= {(int(numbers[0]), m): float(v) for m, v in enumerate(numbers[1:13], 1) if float(v) >= -900}
    return out


def test_month_tables_keep_years_that_are_not_over(spark, tmp_path):
    want = by_hand(BLOCK)
    assert (1953, 5) in want and want[1953, 1] == 9.0 and (1952, 2) not in want and want[1951, 12] == -2.0
    lines = spark.createDataFrame(list(enumerate(BLOCK)), "place int, value string").repartition(3)
    assert {(r["year"], r["month"]): r["value"] for r in files.parse_monthly_block(lines).collect()} == want
    for name, text in (("a.txt", "\n".join(BLOCK)), ("b.txt", "\r\n".join(BLOCK[:9])), ("none.txt", "1950 1.0 2.0"), ("empty.txt", "")):
        (tmp_path / name).write_text(text)
    got = {}
    for r in files.read_monthly_block(spark, str(tmp_path)).collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1], {})[r["year"], r["month"]] = r["value"]
    assert got == {"a.txt": want, "b.txt": by_hand(BLOCK[:9])}
    assert files.parse_monthly_block(lines.where("place < 2")).count() == 0


def test_month_tables_need_no_window(spark):
    plan = files.parse_monthly_block(spark.createDataFrame(list(enumerate(BLOCK)), "place int, value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_bars_with_headers_of_several_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Price,OPEN,High,low,Close,Volume\nTicker,^X,^X,^X,^X,^X\nDate,,,,,\n2020-01-02,1.0,3.0,0.5,2.0,9\n2020-01-03,2.0,4.0,1.5,,9\n")
    (tmp_path / "b.csv").write_text("Date,\"('Open', '^X')\",\"('High', '^X')\",\"('Low', '^X')\",\"('Close', '^X')\"\n2020-01-02 00:00:00,1.0,3.0,0.5,2.0\n")
    (tmp_path / "c.csv").write_text("Date,High,Low\n2020-01-02,1.0,3.0\n")
    a, b = (sorted(map(tuple, files.read_bars(spark, str(tmp_path / f"{n}.csv")).select(F.col("day").cast("string"), "open", "high", "low", "close").collect())) for n in "ab")
    assert a == [("2020-01-02", 1.0, 3.0, 0.5, 2.0), ("2020-01-03", 2.0, 4.0, 1.5, None)] and b == a[:1]
    with pytest.raises(ParamError, match="Close"):
        files.read_bars(spark, str(tmp_path / "c.csv"))


def test_numeric_text_teaches_a_model(spark, tmp_path):
    rng = np.random.default_rng(0)
    z = [np.zeros(2)]
    for _ in range(200):
        z.append(0.8 * z[-1] + rng.normal(size=2) * 0.1)
    (tmp_path / "z.csv").write_text("X0,Y0\n" + "\n".join(",".join(f"{v:.15f}" for v in r) for r in z))
    rows = files.read_numeric(spark, "/nowhere/z.csv", str(tmp_path))
    assert rows.columns == ["_place", "c0", "c1"] and rows.count() == 201
    pairs = prepare.consecutive_pairs(rows.withColumn("series", F.lit(0)), "series", "_place", ["c0", "c1"])
    model = learned.learn(pairs, ["c0", "c1"], hidden=(8,), epochs=30, rate=0.03)
    assert model.dim_x == model.dim_y == 1 and np.abs(model.noise - 0.01 * np.eye(2)).max() < 0.01
    with pytest.raises(ParamError, match="nowhere"):
        files.read_numeric(spark, "/nowhere/other.csv", str(tmp_path))


def test_split_files_come_back(spark, tmp_path):
    df = spark.createDataFrame([(y, m, y + m / 7, -m / 3) for y in range(2000, 2004) for m in range(1, 13)], "year int, month int, x double, y double")
    train, test = prepare.split_by_year(df, 2002)
    manifest = {r["part"]: (r["rows"], list(r["columns"])) for r in files.write_split(train, test, str(tmp_path / "s")).collect()}
    assert manifest == {"train": (36, ["X0", "Y0"]), "test": (12, ["X0", "Y0"])}
    back = files.series_of(files.read_table(spark, str(tmp_path / "s" / "test.csv")), 1, 1)
    assert np.allclose(sorted((r["x_true"][0], r["y"][0]) for r in back.collect()), sorted((r["x"], r["y"]) for r in test.collect()))
    scaled = prepare.scaled_like(train, df, ["x", "y"]).toPandas()
    own = train.toPandas()
    assert np.allclose(scaled.x, (df.toPandas().x - own.x.mean()) / (own.x.std(ddof=0) + 1e-8))


def test_tables_as_text(spark):
    df = spark.createDataFrame([("a_b", 1.23456, None), ("c", float("nan"), 7)], "method string, mse double, n int")
    assert files.text_table(df).splitlines() == ["method     mse   n", "a_b     1.2346  --", "c           --   7"]
    assert files.text_table(df, latex=True).splitlines() == [r"\begin{tabular}{lrr}", r"method & mse & n \\", r"\hline", r"a\_b & 1.2346 & -- \\", r"c & -- & 7 \\", r"\end{tabular}"]

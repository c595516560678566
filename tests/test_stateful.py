"""Streams with typed state: three micro-batches with late rows against the batch filter, a restart, and series that are forgotten."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.operators.filters import filter_series, observations
from tidefold.operators.simulate import simulate
from tidefold.plans import models
from tidefold.streaming.filters import LATE
from tidefold.streaming.stateful import PROVIDER, run_available_typed, stream_filter_typed, typed_state


def put(folder, n, rows):
    import pandas as pd

    os.makedirs(folder, exist_ok=True)
    pd.DataFrame(rows, columns=["series", "k", "v"]).astype({"series": "int64", "k": "int64", "v": "float64"}).to_parquet(f"{folder}/{n}.parquet")
    os.utime(f"{folder}/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))


def live(spark, folder):
    return observations(spark.readStream.schema("series bigint, k bigint, v double").option("maxFilesPerTrigger", 1).parquet(str(folder)), "series", ["k"], ["v"])


@pytest.mark.parametrize("method", ["epkf", "ppf"])
def test_three_micro_batches_with_late_rows(spark, tmp_path, method):
    m, options = models.pairwise_param(), {"n_particles": 40} if method == "ppf" else {}
    rows = [tuple(r) for r in simulate(spark, m, 20, 3).select("series", "k", F.col("y")[0]).orderBy("k", "series").collect()]
    parts = [rows[:20], rows[20:45], rows[45:]]
    late = [(0, 2, 9.0), (2, 1, 9.0), (0, 3, 9.0)]
    for n, part in enumerate(parts):
        put(str(tmp_path / "in"), n, part[::-1] + (late[:1] if n == 1 else late[1:] if n == 2 else []))
    before = spark.conf.get(PROVIDER, None)
    got = run_available_typed(stream_filter_typed(live(spark, tmp_path / "in"), m, method, **options), str(tmp_path / "out"), str(tmp_path / "state")).toPandas()
    assert spark.conf.get(PROVIDER, None) == before
    batch = filter_series(observations(spark.createDataFrame(rows, "series bigint, k bigint, v double"), "series", ["k"], ["v"]), m, method, **options).toPandas()
    a, b = got[got.status != LATE].sort_values(["series", "k"]), batch.sort_values(["series", "k"])
    assert len(a) == 63 and np.allclose([x[0] for x in a.x_upd], [x[0] for x in b.x_upd]) and np.allclose([p[0][0] for p in a.p_upd], [p[0][0] for p in b.p_upd])
    assert sorted(zip(*[got[got.status == LATE][c] for c in ("series", "n_late")], strict=True)) == [(0, 1), (0, 2), (2, 1)]


def test_a_checkpoint_goes_on_and_a_new_one_begins_anew(spark, tmp_path):
    m = models.pairwise_param()
    run = lambda out, state: run_available_typed(stream_filter_typed(live(spark, tmp_path / "in"), m), str(tmp_path / out), str(tmp_path / state))
    put(str(tmp_path / "in"), 0, [(1, k, 0.1 * k) for k in range(4)])
    assert run("a", "s").count() == 4
    put(str(tmp_path / "in"), 1, [(1, k, 0.1 * k) for k in range(4, 7)])
    assert sorted(r["k"] for r in run("a", "s").collect()) == list(range(7))
    assert sorted(r["k"] for r in run("b", "t").collect()) == list(range(7))


def test_idle_series_are_forgotten(spark, tmp_path):
    put(str(tmp_path / "in"), 0, [(1, k, 0.1 * k) for k in range(3)])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    with typed_state(spark):
        q = stream_filter_typed(live(spark, tmp_path / "in"), models.pairwise_param(), idle_ms=1500).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="200 milliseconds").start()
    rows = lambda: spark.read.schema("series bigint, k bigint").parquet(out).collect() if os.path.isdir(out) and os.path.isdir(f"{out}/_spark_metadata") else []
    try:
        until = time.time() + 60
        while len(rows()) < 3 and time.time() < until:
            time.sleep(0.3)
        time.sleep(8)
        # An earlier place than the last one: late if the series were still known.
        put(str(tmp_path / "in"), 1, [(1, 1, 0.5)])
        while len(rows()) < 4 and time.time() < until:
            time.sleep(0.3)
    finally:
        q.stop()
    assert sorted(r["k"] for r in rows()) == [0, 0, 1, 2]

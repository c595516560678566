"""What larger tables bring: series that diverge among others, and work that is dealt by the input's size."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from oracle import rows
from pyspark.sql import functions as F

from tidefold.operators import weights
from tidefold.operators.filters import filter_series, observations
from tidefold.operators.kernels import Extended
from tidefold.plans import catalogue, models
from tidefold.streaming.filters import LATE, advance, run_available, stream_filter
from tidefold.streaming.stateful import run_available_typed, stream_filter_typed


def test_a_series_that_diverges_stops_no_other(spark, tmp_path):
    values = {1: [0.0 if i % 3 else 560.0 for i in range(9)], 2: [20.0 + i for i in range(9)]}
    table = [(100 * u + i, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), u, v) for u, some in values.items() for i, v in enumerate(some)]
    path = str(tmp_path / "events.parquet")
    pd.DataFrame(table, columns=["event_id", "ts", "user_id", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(path)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    got = catalogue.QUERIES["epkf_expsaturant"](spark, str(tmp_path)).toPandas()
    assert len(got) == 18 and got[got.x_0.isna()].user_id.unique().tolist() == [1]
    assert rows(got) == rows(duck.sql(catalogue.SQL["epkf_expsaturant"]).df())


def test_series_of_a_bucket_advance_together():
    """Three micro-batches of 300 series take as many steps as a series has rows, and late rows change nothing."""
    model = models.pairwise_param()
    steps = []

    class Counting(Extended):
        def step(self, state, y, streams):
            steps.append(len(y))
            return super().step(state, y, streams)

    rng = np.random.default_rng(3)
    table = pd.DataFrame([(s, k, rng.normal()) for s in range(300) for k in range(12)], columns=["series", "ord_0", "y_0"])
    late = pd.DataFrame([(s, 1, 9.0) for s in range(0, 300, 2)], columns=table.columns)
    bucket, got = None, []
    for lo in (0, 4, 8):
        part = table[(table.ord_0 >= lo) & (table.ord_0 < lo + 4) & ((table.series % 3 > 0) | (lo != 4))]
        bucket, made = advance(Counting(model), bucket, pd.concat([part, late] if lo else [part]).sample(frac=1, random_state=lo), ["ord_0"], "raise", 0)
        got.append(made)
    got = pd.concat(got)
    assert len(steps) == 11 and max(steps) == 300
    assert (got[got.status == LATE].groupby("series").n_late.apply(list).map(tuple) == (1, 2)).all() and (got.status == LATE).sum() == 300
    kernel = Extended(model)
    for s in (0, 1, 299):
        y = table[(table.series == s) & ((table.series % 3 > 0) | (table.ord_0 < 4) | (table.ord_0 >= 8))].y_0.to_numpy()
        state, _ = kernel.start(y[:1, None], np.zeros(1, np.uint64))
        want = [state.x[0, 0]]
        for v in y[1:]:
            state, _ = kernel.step(state, np.array([[v]]), np.zeros(1, np.uint64))
            want.append(state.x[0, 0])
        mine = got[(got.series == s) & (got.status != LATE)].sort_values("k")
        assert mine.k.tolist() == list(range(len(want))) and np.allclose(mine.x_0, want)


@pytest.mark.parametrize("kind", ["plain", "typed"])
@pytest.mark.parametrize("key", ["bigint", "string"])
def test_streams_of_few_buckets_equal_the_batch_filter(spark, tmp_path, kind, key):
    """More series than buckets, with large numbers and a null one, and values that aren't in order."""
    big = 2**60
    table = spark.createDataFrame([(big + s if s else None, k, float(np.sin(7 * s + k))) for k in range(9) for s in range(7)], "series bigint, k bigint, v double").withColumn("series", F.col("series").cast(key))
    table.orderBy(F.rand(1)).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = observations(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "series", ["k"], ["v"])
    make, run = (stream_filter, run_available) if kind == "plain" else (stream_filter_typed, run_available_typed)
    got = run(make(live, models.pairwise_param(), buckets=2), str(tmp_path / "out"), str(tmp_path / "state"))
    want = filter_series(observations(table, "series", ["k"], ["v"]), models.pairwise_param())
    take = lambda df: sorted((str(r["series"]), r["k"], round(r["x_upd"][0], 9), round(r["p_upd"][0][0], 9)) for r in df.collect())
    assert take(got) == take(want) and got.count() == 63


def test_idle_series_of_a_bucket_are_forgotten():
    kernel = Extended(models.pairwise_param())
    table = pd.DataFrame({"series": [1, 2], "ord_0": [0, 0], "y_0": [0.1, 0.2]})
    bucket, _ = advance(kernel, None, table, ["ord_0"], "raise", 1000)
    bucket, _ = advance(kernel, bucket, table.iloc[:1].assign(ord_0=1), ["ord_0"], "raise", 1500)
    assert sorted(bucket.names) == ["1", "2"] and bucket.since(1000).names == ["1"] and bucket.since(1500) is None


@pytest.mark.parametrize("method", weights.METHODS)
def test_resampling_takes_more_tasks_for_more_rows(spark, monkeypatch, method):
    """A thousand rows at ten rows a task are dealt over 100 tasks, and give what they give in the session's four."""
    df = spark.range(1000).select((F.col("id") % 300).alias("g"), "id", (1.0 + F.col("id") % 7).alias("w"))
    run = lambda: weights.resample(df, "g", "id", F.col("w"), method, seed=2)
    few = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(weights.dealt, "__defaults__", (10,))
    many = run()
    assert sorted(map(tuple, many.collect())) == few and len(few) == 1000
    assert many.where("draw >= 0").rdd.getNumPartitions() >= 100

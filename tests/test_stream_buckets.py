"""State of streams by bucket: its rows are bounded by the buckets, not by the series."""

import pytest
from pyspark.sql import functions as F

from tidefold.operators.filters import filter_series, observations
from tidefold.plans import models
from tidefold.streaming.filters import stream_filter
from tidefold.streaming.stateful import stream_filter_typed, typed_state


@pytest.mark.parametrize("kind", ["upkf", "typed"])
def test_state_has_a_row_a_bucket(spark, tmp_path, kind):
    table = spark.range(900).select((F.col("id") % 300).alias("series"), F.floor(F.col("id") / 300).alias("k"), F.sin("id").alias("v"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = observations(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "series", ["k"], ["v"])
    m, method, make = models.pairwise_param(), "epkf" if kind == "typed" else kind, stream_filter_typed if kind == "typed" else stream_filter
    with typed_state(spark):
        q = make(live, m, method).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    total = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)
    take = lambda df: sorted((r["series"], r["k"], round(r["x_upd"][0], 9), round(r["p_upd"][0][0], 9)) for r in df.collect())
    got = spark.read.parquet(str(tmp_path / "out"))
    assert take(got) == take(filter_series(observations(table, "series", ["k"], ["v"]), m, method)) and got.count() == 900
    assert 0 < total <= 64

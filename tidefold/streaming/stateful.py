"""Filters over unbounded input with typed state: each series' estimate, its count of late rows, and a timer that forgets idle series."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidefold.operators.kernels import Gaussian, build
from tidefold.plans.models import Model
from tidefold.streaming.filters import BUCKET_STATE, BUCKETS, Bucket, advance, bucketed, run_available, setting, vectors

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FilterProcessor(StatefulProcessor):
    """Advances all series of a bucket by the rows of a micro-batch.

    State, for each series: the last step (with particles where the method has some), how many rows came too late, and
    the time of its last rows. A timer goes off when the bucket's longest idle series is to be forgotten.
    """

    def __init__(self, kernel: Gaussian, order: list[str], on_error: str, idle_ms: int | None):
        self.kernel, self.order, self.on_error, self.idle_ms = kernel, order, on_error, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", BUCKET_STATE)

    def _load(self) -> Bucket | None:
        saved = self.bucket.get() if self.bucket.exists() else None
        return Bucket.unpacked(saved, self.kernel.model.dim_x, self.kernel.model.dim_y) if saved is not None else None

    def _save(self, bucket: Bucket, now: int) -> None:
        """Series that have been idle for too long are left out, and the timer is set to when the next one is."""
        if self.idle_ms:
            bucket = bucket.since(now - self.idle_ms)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if bucket is None:
            self.bucket.clear()
            return
        self.bucket.update(bucket.packed())
        if self.idle_ms:
            self.handle.registerTimer(int(bucket.seen.min()) + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0
        bucket, made = advance(self.kernel, self._load(), pd.concat(list(rows)), self.order, self.on_error, now)
        self._save(bucket, now)
        yield made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bucket = self._load()
        if bucket is not None:
            self._save(bucket, timerValues.getCurrentProcessingTimeInMs())
        return iter([])

    def close(self) -> None:
        pass


def stream_filter_typed(df: DataFrame, model: Model, method: str = "epkf", *, on_error: str = "raise", idle_ms: int | None = None, buckets: int = BUCKETS, **options) -> DataFrame:
    """series, k, y, status, x_upd, p_upd and n_late for a streaming table of observations(...): a row for each input row.

    A micro-batch's rows of a series are sorted; one at or before the last that was filtered is late: null k, status LATE,
    counted in n_late, and nothing else changes. The result equals the batch filter's where no row is late, however rows
    are dealt to micro-batches. Series are dealt into buckets by hash, and those of a bucket advance together: a task
    holds a bucket's rows of a micro-batch, so bound these (maxBytesPerTrigger, or arriving() where rows must come in order) or take more buckets.
    idle_ms: a series without rows for so long is forgotten, and begins anew; such a stream doesn't end by itself, so
    give it only to streams that run on. The state store must be RocksDB: see typed_state.
    """
    kernel = build(method, model, **options)
    rows, order, schema = bucketed(df, model, buckets)
    made = rows.groupBy("bucket").transformWithStateInPandas(FilterProcessor(kernel, order, on_error, idle_ms), schema, "append", "ProcessingTime" if idle_ms else "None")
    return vectors(made, model, "n_late")


@contextmanager
def typed_state(spark: SparkSession):
    """Within it, streams that start keep their state in RocksDB, which typed state needs; the session's setting comes back after."""
    with setting(spark, PROVIDER, ROCKS):
        yield


def run_available_typed(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> DataFrame:
    """run_available for typed state. A new checkpoint begins anew; the same one goes on from where it was."""
    with typed_state(stream.sparkSession):
        return run_available(stream, path, checkpoint, buckets)

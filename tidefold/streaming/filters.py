"""Filters over unbounded input: each series' state is kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.errors import ParamError
from tidefold.operators.filters import advanced, joined, partitions_of, streams_of
from tidefold.operators.kernels import Gaussian, State, build
from tidefold.plans.models import Model

#: Status of a row that isn't after its series' last one: it changes nothing.
LATE = 9
#: Series are dealt into so many buckets by hash; a bucket's series advance together. A checkpoint keeps its number.
BUCKETS = 64
#: Tasks that deal a slice of arriving(...).
SLICE_TASKS = 32
#: A bucket's state: for each series its name, last step, last place, count of late rows and the time of its last rows.
BUCKET_STATE = "names array<string>, k array<bigint>, x array<double>, p array<double>, y array<double>, status array<int>, last array<bigint>, late array<bigint>, seen array<bigint>, cloud array<double>, weights array<double>, lost array<bigint>"


@dataclass
class Bucket:
    """The series of a bucket, in any order: arrays whose first axis is the series."""

    names: list[str]
    state: State
    last: np.ndarray
    late: np.ndarray
    seen: np.ndarray

    @classmethod
    def unpacked(cls, saved: tuple, dim_x: int, dim_y: int) -> Bucket:
        names, k, x, p, y, status, last, late, seen, cloud, weights, lost = saved
        n = len(names)
        more = {"cloud": np.array(cloud, float).reshape(n, -1, dim_x), "weights": np.array(weights, float).reshape(n, -1), "lost": np.array(lost, np.int64)} if len(lost) else {}
        state = State(np.array(x, float).reshape(n, dim_x), np.array(p, float).reshape(n, dim_x, dim_x), np.array(y, float).reshape(n, dim_y), np.array(k, np.int64), np.array(status, np.int8), more)
        return cls(list(names), state, np.array(last, np.int64).reshape(n, -1), np.array(late, np.int64), np.array(seen, np.int64))

    def packed(self) -> tuple:
        s = self.state
        flat = [np.ravel(v).tolist() for v in (s.k, s.x, s.p, s.y, s.status, self.last, self.late, self.seen)]
        return (self.names, *flat, *[np.ravel(s.more[c]).tolist() if c in s.more else [] for c in ("cloud", "weights", "lost")])

    def since(self, time: int) -> Bucket | None:
        """The series that have had rows after a time; None where there are none."""
        rows = np.flatnonzero(self.seen > time)
        return Bucket([self.names[i] for i in rows], self.state.take(rows), self.last[rows], self.late[rows], self.seen[rows]) if len(rows) else None


def advance(kernel: Gaussian, bucket: Bucket | None, table: pd.DataFrame, order: list[str], on_error: str, now: int) -> tuple[Bucket, pd.DataFrame]:
    """The bucket after a micro-batch's rows (series, order, y_0..), and a row for each with n_late, k (-1: late), status, x_i and p_i_j."""
    m, n = kernel.model, len(table)
    codes, keys = pd.factorize(table["series"], use_na_sentinel=False)
    keys = [None if k is None or k is pd.NaT else k for k in keys]
    places = table[order].to_numpy(np.int64)
    # A micro-batch's rows of a bucket are sorted together: the batch bounds them.
    by = np.lexsort((*places.T[::-1], codes))
    table, codes, places = table.iloc[by], codes[by], places[by]
    y = table[[f"y_{i}" for i in range(m.dim_y)]].to_numpy(float)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    names, streams = [str(k) for k in keys], streams_of(keys)
    at = {name: i for i, name in enumerate(bucket.names)} if bucket else {}
    old = np.array([at.get(name, -1) for name in names], np.int64)
    known = old >= 0
    late = np.concatenate(([False], (codes[1:] == codes[:-1]) & (places[1:] == places[:-1]).all(1)))
    if known.any():
        last, equal = bucket.last[old][codes], np.ones(n, bool)
        before = np.zeros(n, bool)
        for c in range(places.shape[1]):
            before |= equal & (places[:, c] < last[:, c])
            equal &= places[:, c] == last[:, c]
        late |= known[codes] & (before | equal)
    size = np.bincount(codes[~late], minlength=len(keys))
    # Rows that count, without gaps: of series i from first_on[i] on.
    on = np.flatnonzero(~late)
    first_on = np.cumsum(size) - size
    seen = y[on]
    k, status = np.zeros(len(on), np.int64), np.zeros(len(on), np.int8)
    out = {"x_upd": np.full((len(on), m.dim_x), np.nan), "p_upd": np.full((len(on), m.dim_x, m.dim_x), np.nan)}
    fresh = np.flatnonzero(~known)
    state = bucket.state.take(old[known]) if known.any() else None
    if len(fresh):
        rows = first_on[fresh]
        started, made = kernel.start(seen[rows], streams[fresh])
        for c in out:
            out[c][rows] = made[c]
        state = started if state is None else joined(state, started)
    # States of known series come first.
    turn = np.concatenate((np.flatnonzero(known), fresh))
    begin, left = (first_on + ~known)[turn], (size - ~known)[turn]
    state = advanced(kernel, state, streams[turn], begin, left, table["series"].to_numpy()[on], seen, on_error, k, status, out)
    state = state.take(np.argsort(turn))
    counted = np.cumsum(late)
    base = np.where(known, bucket.late[old], 0) if known.any() else np.zeros(len(keys), np.int64)
    n_late = base[codes] + counted - (counted - late)[first][codes]
    ends = np.concatenate((first[1:], [n])) - 1
    # Late rows come first of their series, or equal one that counts.
    newest = np.where((size > 0)[:, None], places[ends], bucket.last[old] if known.any() else 0)
    new = Bucket(names, state, newest, n_late[ends], np.full(len(keys), now))
    if bucket:
        rest = np.setdiff1d(np.arange(len(bucket.names)), old)
        both = lambda a, b: np.concatenate([a[rest], b])
        new = Bucket([bucket.names[i] for i in rest] + names, joined(bucket.state.take(rest), state), both(bucket.last, newest), both(bucket.late, new.late), both(bucket.seen, new.seen))
    columns = {"series": table["series"].to_numpy(), **{f"y_{i}": y[:, i] for i in range(m.dim_y)}, "n_late": n_late}

    def whole(values: np.ndarray, empty) -> np.ndarray:
        all_rows = np.full(n, empty, values.dtype)
        all_rows[on] = values
        return all_rows

    columns |= {"k": whole(k, -1), "status": whole(status.astype(np.int32), LATE)}
    columns |= {f"x_{i}": whole(out["x_upd"][:, i], np.nan) for i in range(m.dim_x)} | {f"p_{i}_{j}": whole(out["p_upd"][:, i, j], np.nan) for i in range(m.dim_x) for j in range(m.dim_x)}
    return new, pd.DataFrame(columns)


def bucketed(df: DataFrame, model: Model, buckets: int) -> tuple[DataFrame, list[str], str]:
    """(bucket, series, ord_0.., y_0..) of observations(...), the order columns, and the schema of what advance() gives."""
    if not isinstance(buckets, int) or buckets < 1:
        raise ParamError("buckets must be a positive integer")
    order = [c for c in df.columns if c.startswith("ord_")]
    as_number = {c: F.unix_micros(F.col(c).cast("timestamp")) if isinstance(df.schema[c].dataType, T.TimestampType | T.TimestampNTZType) else F.col(c).cast("long") for c in order}
    # A null series is alone in its bucket, so that no other key's type changes in pandas.
    bucket = F.when(F.col("series").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("series"), F.lit(buckets)).cast("int"))
    fits = F.coalesce(F.size("y"), F.lit(-1)) == model.dim_y
    y = F.when(fits, F.col("y")).otherwise(F.raise_error(F.lit(f"a row needs {model.dim_y} observations")))
    rows = df.select(bucket.alias("bucket"), "series", *[as_number[c].alias(c) for c in order], *[y[i].alias(f"y_{i}") for i in range(model.dim_y)])
    ys, xs, ps = ([f"y_{i}" for i in range(model.dim_y)], [f"x_{i}" for i in range(model.dim_x)], [f"p_{i}_{j}" for i in range(model.dim_x) for j in range(model.dim_x)])
    schema = f"series {df.schema['series'].dataType.simpleString()}, {', '.join(f'{c} double' for c in ys)}, n_late bigint, k bigint, status int, {', '.join(f'{c} double' for c in xs + ps)}"
    return rows, order, schema


def vectors(df: DataFrame, model: Model, *more: str) -> DataFrame:
    """series, k, y, status, x_upd, p_upd and more from what advance() gives."""
    # pandas' NaN comes as null; a row that counts has no other nulls.
    number = lambda c: F.coalesce(F.col(c), F.lit(float("nan")))
    counts = F.col("status") != LATE

    def timely(c: Column) -> Column:
        return F.when(counts, c)

    x = F.array(*[number(f"x_{i}") for i in range(model.dim_x)])
    p = F.array(*[F.array(*[number(f"p_{i}_{j}") for j in range(model.dim_x)]) for i in range(model.dim_x)])
    y = F.array(*[number(f"y_{i}") for i in range(model.dim_y)])
    return df.select("series", timely(F.col("k")).alias("k"), y.alias("y"), "status", timely(x).alias("x_upd"), timely(p).alias("p_upd"), *more)


def stream_filter(df: DataFrame, model: Model, method: str = "epkf", *, on_error: str = "raise", timeout: str | None = None, buckets: int = BUCKETS, **options) -> DataFrame:
    """series, k, y, status, x_upd and p_upd for a streaming table of observations(...): one row for each input row.

    Order columns are numbers or timestamps. Within a micro-batch a series' rows are sorted; a row at or before the last
    one that was filtered is late: null k, status LATE. The result equals the batch filter's wherever no row is late, in
    whatever micro-batches rows come. State is the last estimate, for particle filters also the particles (n_particles
    times the state's dimension). Series are dealt into buckets by hash, and those of a bucket advance together: a task
    holds a bucket's rows of a micro-batch and its series' states, so larger streams take more buckets. timeout:
    milliseconds, as text, after which an idle series is forgotten.
    """
    kernel = build(method, model, **options)
    rows, order, schema = bucketed(df, model, buckets)
    idle = int(timeout) if timeout else None

    def step(_: tuple, batches: Iterator[pd.DataFrame], handle) -> Iterator[pd.DataFrame]:
        bucket = Bucket.unpacked(handle.get, model.dim_x, model.dim_y) if handle.exists else None
        now, made = handle.getCurrentProcessingTimeMs() if idle else 0, None
        if not handle.hasTimedOut:
            bucket, made = advance(kernel, bucket, pd.concat(list(batches)), order, on_error, now)
        if idle:
            bucket = bucket.since(now - idle)
        if bucket is None:
            handle.remove()
        else:
            handle.update(bucket.packed())
            if idle:
                handle.setTimeoutDuration(max(1, int(bucket.seen.min()) + idle - now))
        if made is not None:
            yield made

    return vectors(rows.groupBy("bucket").applyInPandasWithState(step, schema, BUCKET_STATE, "append", "ProcessingTimeTimeout" if timeout else "NoTimeout"), model)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Within it, the session's key has this value, which streams that start keep; the one before comes back after."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run_available(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> DataFrame:
    """Runs a stream over all input at hand into Parquet at path, and reads that.

    State is dealt over no more tasks than there are buckets: others would be empty, and each costs a Python worker and a
    state store at every micro-batch. A checkpoint keeps its number.
    """
    with setting(stream.sparkSession, "spark.sql.shuffle.partitions", str(min(partitions_of(stream), buckets))):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def arriving(df: DataFrame, order: list[str], rows: int, slices: str, live: str) -> Iterator[DataFrame]:
    """A table as a stream that comes in its order, whatever files hold it: the stream of the folder live, once for each slice of about so many rows.

    A row in a later micro-batch than a later one of its series is late, and files needn't follow the order. So rows are dealt
    by range of the order columns into Parquet at slices, and slices are appended to live one at a time. Run the stream over
    all input at hand each time it is given, with one checkpoint: a run takes one slice, as one micro-batch, and goes on from
    the states of the one before. Work and space follow the table, a micro-batch doesn't.
    """
    spark, n = df.sparkSession, max(1, -(-df.count() // rows))
    dealt = df.repartitionByRange(n * SLICE_TASKS, *order).withColumn("slice", F.floor(F.spark_partition_id() / SLICE_TASKS).cast("int"))
    dealt.write.partitionBy("slice").parquet(slices)
    for i in range(n):
        spark.read.parquet(slices).where(F.col("slice") == i).select(*df.columns).write.mode("append").parquet(live)
        yield spark.readStream.schema(df.schema).parquet(live)

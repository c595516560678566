"""Filtering of many series: rows are dealt by key and sorted, and each task folds them batch by batch with bounded memory."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.errors import ParamError
from tidefold.operators.kernels import ERRORS, OK, Gaussian, State, build
from tidefold.plans.models import Model

#: Columns of a step: vectors and matrices; s, gain and innov are null for particle filters after the first row.
VECTORS, MATRICES = ("x_pred", "innov", "x_upd"), ("p_pred", "s", "gain", "p_upd")
ALL = ("x_pred", "p_pred", "innov", "s", "gain", "x_upd", "p_upd")
#: Counts a step may give besides: of particle filters, for how many steps in a row no particle has had any weight.
COUNTS = ("n_degenerate",)


def observations(df: DataFrame, key: Column | str, order: list[Column | str], y: list[Column | str], x: list[Column | str] | None = None) -> DataFrame:
    """(series, ord_0.., x, y) of any table: what the filters read. x is null where no truth is given."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    truth = F.array(*[col(c).cast("double") for c in x]) if x else F.lit(None).cast("array<double>")
    return df.select(col(key).alias("series"), *[col(c).alias(f"ord_{i}") for i, c in enumerate(order)], truth.alias("x_true"), F.array(*[col(c).cast("double") for c in y]).alias("y"))


def streams_of(keys: list, seed: int = 0) -> np.ndarray:
    """A random stream for each key, the same on every machine."""
    return np.array([int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=8).digest(), "little") for k in keys], np.uint64)


class Fold:
    """Runs a kernel over batches of rows that come sorted by series; the last series' state goes over to the next batch."""

    def __init__(self, kernel: Gaussian, limit: int | None, on_error: str):
        self.kernel, self.limit, self.on_error = kernel, limit, on_error
        self.key, self.state = None, None

    def run(self, keys: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
        """keys: objects, equal ones together. Returns (rows that have a result, k, status, columns) in the rows' order."""
        n, m = len(keys), self.kernel.model
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.concatenate((first, [n])))
        goes_on = self.state is not None and keys[0] == self.key
        streams = streams_of([keys[i] for i in first])
        dims = {"x_pred": (m.dim_x,), "x_upd": (m.dim_x,), "innov": (m.dim_y,), "p_pred": (m.dim_x,) * 2, "p_upd": (m.dim_x,) * 2, "s": (m.dim_y,) * 2, "gain": (m.dim_x, m.dim_y)}
        out = {c: np.full((n, *d), np.nan) for c, d in dims.items()} | {c: np.zeros(n, np.int64) for c in COUNTS}
        k, status = np.zeros(n, np.int64), np.zeros(n, np.int8)
        fresh = np.arange(len(first)) >= int(goes_on)
        begin = first + fresh  # fresh series' first rows are done by start()
        state = None
        if fresh.any():
            rows = first[fresh]
            started, made = self.kernel.start(y[rows], streams[fresh])
            for c, v in made.items():
                out[c][rows] = v
            state = started
        if goes_on:
            state = self.state if state is None else joined(self.state, state)
        left = size - fresh
        if self.limit is not None:  # what comes after isn't filtered
            left = np.minimum(left, np.maximum(self.limit - state.k, 0))
        state = advanced(self.kernel, state, streams, begin, left, keys, y, self.on_error, k, status, out)
        self.key, self.state = keys[-1], state.take(slice(len(first) - 1, None))
        keep = np.arange(n)
        if self.limit is not None:
            done = np.zeros(n, bool)
            done[first[fresh]] = True
            for at, m in zip(begin.tolist(), left.tolist(), strict=True):
                done[at : at + m] = True
            keep = np.flatnonzero(done)
        return keep, k, status, out


def advanced(kernel: Gaussian, state: State, streams: np.ndarray, begin: np.ndarray, left: np.ndarray, keys: np.ndarray, y: np.ndarray, on_error: str, k: np.ndarray, status: np.ndarray, out: dict) -> State:
    """Series i goes from state[i] through left[i] rows of y from begin[i] on, all series together; k, status and out are filled by row."""
    # Longest first, so that the series still running are always a front part.
    order = np.argsort(-left, kind="stable")
    state, begin, left, streams = state.take(order), begin[order], left[order], streams[order]
    for t in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -(t + 1), "right"))
        rows = begin[:live] + t
        new, made = kernel.step(state.take(slice(0, live)), y[rows], streams[:live])
        state.put(slice(0, live), new)
        for c, v in made.items():
            if v is not None and c in out:
                out[c][rows] = v
        k[rows], status[rows] = new.k, new.status
        if on_error == "raise" and (new.status != OK).any():
            bad = int(np.flatnonzero(new.status != OK)[0])
            raise ERRORS[int(new.status[bad])](f"series {keys[rows[bad]]!r}, step {int(new.k[bad])}")
    return state.take(np.argsort(order))


def joined(a: State, b: State) -> State:
    both = lambda u, v: np.concatenate([u, v])
    return State(both(a.x, b.x), both(a.p, b.p), both(a.y, b.y), both(a.k, b.k), both(a.status, b.status), {c: both(a.more[c], b.more[c]) for c in a.more})


def nested(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """An Arrow list (of lists) of doubles from an array (rows, n) or (rows, n, m)."""
    flat = pa.array(np.ascontiguousarray(values).ravel())
    for width in reversed(values.shape[1:]):
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), flat)
    if null is not None and null.any():
        flat = pa.compute.if_else(pa.array(~null), flat, pa.nulls(len(flat), flat.type))
    return flat


def keys_of(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def partitions_of(df: DataFrame) -> int:
    """As many tasks as the session's shuffles have: a fold's rows are few and dear, so they aren't joined into larger partitions by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def runs_of(batch: pa.RecordBatch, column: int):
    """(value, rows) for each run of one value of a column in a batch that comes sorted by it."""
    values = keys_of(batch.column(column))
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), len(values)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi > lo:
            yield values[lo], batch.slice(lo, hi - lo)


def filter_each(df: DataFrame, entrants: dict[float, list[tuple[str, Model, str, dict]]], *, output: tuple[str, ...] = ALL) -> DataFrame:
    """Filters several models' series in one plan: (value, method, series, k, x_true, y, status, output) from (value, ord_0, series, x_true, y).

    entrants[value] are the filters of a value's series: name (the column method), model, method and options as of
    filter_series. Rows are shuffled once and each is read by all its value's filters. A step that fails gives NaN and a
    status, as on_error="skip" does. A null observation or a value without entrants is an error.
    """
    kernels = {value: [(name, build(method, model, **options), method in ("pf", "ppf")) for name, model, method, options in some] for value, some in entrants.items()}
    empty = F.col("y").isNull() | F.exists("y", lambda v: v.isNull())
    rows = df.withColumn("y", F.when(empty, F.raise_error(F.lit("an observation is null"))).otherwise(F.col("y")))
    rows = rows.repartition(partitions_of(df), "value", "series").sortWithinPartitions("value", "series", "ord_0").select("value", "series", "x_true", "y")
    key_type = df.schema["series"].dataType.simpleString()
    names = ["value", "method", "series", "k", "x_true", "y", "status", *output]

    def run(batches):
        folds, at = [], None
        for batch in batches:
            for value, part in runs_of(batch, 0):
                if value not in kernels:
                    raise ParamError(f"no filters for {value}")
                if value != at:
                    folds, at = [(name, Fold(kernel, None, "skip"), particles) for name, kernel, particles in kernels[value]], value
                keys, y = keys_of(part.column(1)), part.column(3).flatten().to_numpy().reshape(len(part), -1)
                for name, fold, particles in folds:
                    _, k, status, out = fold.run(keys, y)
                    columns = [part.column(0), pa.array([name] * len(part)), part.column(1), pa.array(k), part.column(2), part.column(3), pa.array(status.astype(np.int32))]
                    columns += [nested(out[c], k > 0 if particles and c in ("innov", "s", "gain") else None) for c in output]
                    yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "".join(f", {c} {'array<double>' if c in VECTORS else 'array<array<double>>'}" for c in output)
    return rows.mapInArrow(run, f"value double, method string, series {key_type}, k bigint, x_true array<double>, y array<double>, status int{kinds}")


def filter_series(df: DataFrame, model: Model, method: str = "epkf", *, output: tuple[str, ...] = ("x_pred", "p_pred", "innov", "s", "gain", "x_upd", "p_upd"), limit: int | None = None, on_error: str = "raise", missing: str = "raise", **options) -> DataFrame:
    """Filters observations(...): series, k (from 0), x_true, y, status and the columns of output.

    limit: the last k (so limit + 1 rows); later rows aren't filtered. output may have n_degenerate as well. on_error: raise, or skip to give NaN and a status from the failing row on
    (with epkf's guards=False what arithmetic gives, and a status).
    missing: raise on a null y, or drop such rows. Rows are shuffled once, by series; within a task all series of a batch
    advance together, and a series longer than a batch goes on from its state, so one long series needs no more memory.
    A row's place is its order among the series' rows; ties in the order columns should be broken by the caller.
    """
    if limit is not None and (not isinstance(limit, int) or limit <= 0):
        raise ParamError("limit must be a positive integer")
    if on_error not in ("raise", "skip") or missing not in ("raise", "drop"):
        raise ParamError("on_error is raise or skip, missing is raise or drop")
    if unknown := set(output) - {*ALL, *COUNTS}:
        raise ParamError(f"there is no column {sorted(unknown)[0]!r}")
    kernel = build(method, model, **options)
    order = [c for c in df.columns if c.startswith("ord_")]
    empty = F.col("y").isNull() | F.exists("y", lambda v: v.isNull())
    rows = df.where(~empty) if missing == "drop" else df.withColumn("y", F.when(empty, F.raise_error(F.lit("an observation is null"))).otherwise(F.col("y")))
    rows = rows.repartition("series").sortWithinPartitions("series", *order).select("series", "x_true", "y")
    key_type = df.schema["series"].dataType.simpleString()
    kinds = {c: "bigint" if c in COUNTS else "array<double>" if c in VECTORS else "array<array<double>>" for c in output}
    particles = method in ("pf", "ppf")

    def run(batches):
        fold = Fold(kernel, limit, on_error)
        for batch in batches:
            if not len(batch):
                continue
            y = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
            if y.shape[1] != model.dim_y:
                raise ParamError(f"the model has {model.dim_y} observations, the rows have {y.shape[1]}")
            keep, k, status, out = fold.run(keys_of(batch.column(0)), y)
            chosen = pa.array(keep)
            later = k[keep] > 0
            columns = [batch.column(0).take(chosen), pa.array(k[keep]), batch.column(1).take(chosen), batch.column(2).take(chosen), pa.array(status[keep].astype(np.int32))]
            columns += [nested(out[c][keep], later if particles and c in ("innov", "s", "gain") else None) for c in output]
            yield pa.RecordBatch.from_arrays(columns, ["series", "k", "x_true", "y", "status", *output])

    schema = f"series {key_type}, k bigint, x_true array<double>, y array<double>, status int" + "".join(f", {c} {kinds[c]}" for c in output)
    return rows.mapInArrow(run, schema)

"""A model whose dynamics a small network learns from consecutive rows: tasks sum gradients, the driver takes Adam's steps."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.errors import ParamError
from tidefold.plans.models import Model
from tidefold.sources.scratch import scratch

log = logging.getLogger(__name__)
# The optimiser's decays, its guard, and the hidden layers.
DECAY, DECAY_SQUARES, GUARD = 0.9, 0.999, 1e-8
HIDDEN = (64, 64)
#: Sums of gradients that are added up at once.
FAN = 64


@dataclass(frozen=True, eq=False)
class Network:
    """Layers (weights, biases) with tanh between them, over standardised columns."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    mean: np.ndarray
    std: np.ndarray

    @staticmethod
    def fresh(dim: int, hidden: tuple[int, ...], mean: np.ndarray, std: np.ndarray, seed: int) -> Network:
        """Weights and biases uniform within one over the root of a layer's inputs."""
        rng, sizes = np.random.default_rng(seed), (dim, *hidden, dim)
        bound = [1 / math.sqrt(n) for n in sizes[:-1]]
        return Network(tuple((rng.uniform(-b, b, (n, m)), rng.uniform(-b, b, n)) for m, n, b in zip(sizes[:-1], sizes[1:], bound, strict=True)), mean, std)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for layer in self.layers for x in layer])

    def with_flat(self, values: np.ndarray) -> Network:
        at, layers = 0, []
        for w, b in self.layers:
            layers.append((values[at : at + w.size].reshape(w.shape), values[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return Network(tuple(layers), self.mean, self.std)

    def _through(self, h: np.ndarray) -> list[np.ndarray]:
        """What each layer gives, the input first."""
        out = [h]
        for i, (w, b) in enumerate(self.layers):
            h = h @ w.T + b
            out.append(h if i + 1 == len(self.layers) else np.tanh(h))
            h = out[-1]
        return out

    def predict(self, z: np.ndarray) -> np.ndarray:
        """The next z for arrays whose last axis holds the columns."""
        return self._through((z - self.mean) / self.std)[-1] * self.std + self.mean

    def slopes(self, z: np.ndarray) -> np.ndarray:
        """(rows, i, j): derivative of output i by input j."""
        made = self._through((z - self.mean) / self.std)
        out = np.broadcast_to(self.layers[0][0], (len(z), *self.layers[0][0].shape))
        for (w, _), h in zip(self.layers[1:], made[1:-1], strict=True):
            out = np.einsum("oh,nh,nhi->noi", w, 1 - h * h, out)
        return out * self.std[:, None] / self.std

    def gradient(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
        """(gradient, sum) of the squared errors of standardised rows a, whose next ones are b."""
        made = self._through(a)
        error = made[-1] - b
        back, out = 2 * error, []
        for i in range(len(self.layers) - 1, -1, -1):
            out += [back.sum(0), (back.T @ made[i]).ravel()]
            back = (back @ self.layers[i][0]) * (1 - made[i] * made[i]) if i else back
        return np.concatenate(out[::-1]), float((error * error).sum())

    def equations(self, fn, z: list) -> list:
        """The same as predict, for one column or expression each."""
        h = [(c + -float(m)) * (1 / float(s)) for c, m, s in zip(z, self.mean, self.std, strict=True)]
        for i, (w, b) in enumerate(self.layers):
            sums = []
            for row, shift in zip(w.tolist(), b.tolist(), strict=True):
                total = row[0] * h[0]
                for c, x in zip(row[1:], h[1:], strict=True):
                    total = total + c * x
                sums.append(total + shift)
            h = sums if i + 1 == len(self.layers) else [fn.tanh(s) for s in sums]
        return [c * float(s) + float(m) for c, m, s in zip(h, self.mean, self.std, strict=True)]


@dataclass(frozen=True, eq=False)
class LearnedModel(Model):
    """A pairwise model z' = network(z) + noise, by matrices where a filter asks for arrays."""

    network: Network | None = None

    def g_numpy(self, z: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.network.predict(z) + v

    def jacobians_numpy(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        unit = np.broadcast_to(np.eye(self.dim), (len(z), self.dim, self.dim))
        return self.network.predict(z), self.network.slopes(z), unit


def model_of(network: Network, noise: np.ndarray, mean: np.ndarray, prior: np.ndarray, dim_x: int, name: str = "learned") -> LearnedModel:
    def step(fn, x, y, t, u):
        out = network.equations(fn, [*x, *y])
        return [a + b for a, b in zip(out[:dim_x], t, strict=True)], [a + b for a, b in zip(out[dim_x:], u, strict=True)]

    return LearnedModel(name, dim_x, len(mean) - dim_x, "pairwise", noise, mean, prior, step, network=network)


def _standardised(pairs: DataFrame, columns: list[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(pairs as _a and _b, arrays, standardised by the first rows' moments; means; standard deviations plus 1e-8)."""
    row = pairs.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    if row[0] is None:
        raise ParamError("there are no pairs to learn from")
    mean, std = np.array(row[: len(columns)], float), np.array(row[len(columns) :], float) + 1e-8
    scaled = lambda names: F.array(*[(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(names, mean, std, strict=True)])
    return pairs.select(scaled(columns).alias("_a"), scaled([f"next_{c}" for c in columns]).alias("_b")), mean, std


def _pairs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(i).flatten().to_numpy().reshape(len(batch), -1) for i in range(2))


def _sums(rows: DataFrame, network: Network) -> tuple[np.ndarray, float, int]:
    """Gradient, squared error and number of rows, summed in tasks first and then FAN tasks at a time, so the driver gets few rows of the network's size."""

    def summed(batches):
        total, loss, n = np.zeros(len(network.flat())), 0.0, 0
        for batch in batches:
            g, e = network.gradient(*_pairs_of(batch))
            total, loss, n = total + g, loss + e, n + len(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([loss]), pa.array([n])], ["g", "loss", "n"])

    def added(batches):
        total, loss, n = np.zeros(len(network.flat())), 0.0, 0
        for batch in batches:
            for g in batch.column(0).to_pylist():
                total = total + np.frombuffer(g)
            loss, n = loss + sum(batch.column(1).to_pylist()), n + sum(batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([loss]), pa.array([n])], ["g", "loss", "n"])

    schema = "g binary, loss double, n bigint"
    parts, out = rows.rdd.getNumPartitions(), rows.mapInArrow(summed, schema)
    while parts > FAN:
        parts = math.ceil(parts / FAN)
        out = out.repartition(parts).mapInArrow(added, schema)
    got = out.collect()
    return sum((np.frombuffer(r["g"]) for r in got), np.zeros(len(network.flat()))), sum(r["loss"] for r in got), sum(r["n"] for r in got)


def fit(pairs: DataFrame, columns: list[str], *, hidden: tuple[int, ...] = HIDDEN, epochs: int = 500, rate: float = 1e-3, slices: int = 1, seed: int = 42, told: Callable[[int, float], None] | None = None) -> Network:
    """A network that gives next_... of columns from columns, by Adam on the mean squared error of standardised rows.

    pairs: as consecutive_pairs makes them; rows with a null are left out. slices: steps of an epoch; pairs are dealt by
    hash into so many folders, and a step reads one. A step is a job: tasks return sums of gradients (a vector of the
    network's size each), never rows. told(epoch, loss) hears of every tenth epoch.
    """
    if epochs < 1 or slices < 1:
        raise ParamError("epochs and slices must be positive")
    spark = pairs.sparkSession
    rows, mean, std = _standardised(pairs.na.drop(subset=[*columns, *[f"next_{c}" for c in columns]]), columns)
    rows.withColumn("_slice", F.pmod(F.xxhash64("_a", "_b"), F.lit(slices))).write.partitionBy("_slice").parquet(path := scratch(spark, "pairs"))
    whole = spark.read.schema("_a array<double>, _b array<double>, _slice bigint").parquet(path)
    network = Network.fresh(len(columns), hidden, mean, std, seed)
    weights = network.flat()
    first, second, step = np.zeros_like(weights), np.zeros_like(weights), 0
    some = [whole.where(F.col("_slice") == i).select("_a", "_b") for i in range(slices)]
    for epoch in range(1, epochs + 1):
        seen, loss = 0, 0.0
        for part in some:
            g, e, n = _sums(part, network.with_flat(weights))
            if not n:
                continue
            g, step = g / (n * len(columns)), step + 1
            first, second = DECAY * first + (1 - DECAY) * g, DECAY_SQUARES * second + (1 - DECAY_SQUARES) * g * g
            weights = weights - rate * (first / (1 - DECAY**step)) / (np.sqrt(second / (1 - DECAY_SQUARES**step)) + GUARD)
            seen, loss = seen + n, loss + e
        if epoch % 10 == 0:
            log.info("epoch %d of %d: loss %.6e", epoch, epochs, loss / max(1, seen * len(columns)))
            if told:
                told(epoch, loss / max(1, seen * len(columns)))
    return network.with_flat(weights)


def residual_noise(pairs: DataFrame, columns: list[str], network: Network) -> np.ndarray:
    """Sample covariance of what the network leaves of the next rows."""
    names = [f"r_{i}" for i in range(len(columns))]

    def left(batches):
        for batch in batches:
            z = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(float)
            r = z[:, len(columns) :] - network.predict(z[:, : len(columns)])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r[:, i])) for i in range(len(columns))], names)

    rows = pairs.select(*[F.col(c).cast("double") for c in [*columns, *[f"next_{c}" for c in columns]]]).na.drop().mapInArrow(left, ", ".join(f"{n} double" for n in names))
    some = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    got = rows.agg(*[F.covar_samp(names[i], names[j]) for i, j in some]).first()
    if any(v is None for v in got):
        raise ParamError("noise needs two pairs at least")
    out = np.zeros((len(columns),) * 2)
    for (i, j), v in zip(some, got, strict=True):
        out[i, j] = out[j, i] = v
    return out


def learn(pairs: DataFrame, columns: list[str], dim_x: int = 1, *, start: np.ndarray | None = None, spread: float = 1.0, **options) -> LearnedModel:
    """The model that pairs teach: noise from the residuals, prior spread times that around start (by default the mean of the rows)."""
    network = fit(pairs, columns, **options)
    noise = residual_noise(pairs, columns, network)
    return model_of(network, noise, network.mean if start is None else np.asarray(start, float), spread * noise, dim_x)

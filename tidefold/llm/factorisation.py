"""Factorisation machine over hashed terms of texts: features, bounded sample, training in one task, scoring in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import ALNUM_BYTES, LOWER, NON_BLANK_BYTES, Words, doc_sums, in_arrow, released, stored, text_runs

#: The first RESERVED bins are for buckets of structure statistics.
RESERVED = 512


def _share_buckets(x: np.ndarray) -> np.ndarray:
    """Buckets of a share: 0 for none, then ever wider."""
    return np.searchsorted([1e-9, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], x, "right")


def structure_bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of bucketed structure statistics and of the length: one bin for each statistic and text."""
    w, n = Words(data, offsets, NON_BLANK_BYTES), len(offsets) - 1
    words, size = np.diff(w.first), np.maximum(np.diff(offsets), 1)
    per_word = 1 / np.maximum(words, 1)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])

    h = w.hashes()
    order = np.lexsort((h, w.doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    letters = ((data | 32) >= 97) & ((data | 32) <= 122)
    marks = np.isin(data, np.frombuffer(b"#*$%&|<>!", np.uint8))
    stats = (
        doc_sums(new.astype(float), w.doc[order], n) * per_word,
        doc_sums(again.astype(float), w.doc, n) * per_word,
        count((data >= 65) & (data <= 90)) / np.maximum(count(letters), 1),
        count(marks) / size,
        count((data >= 48) & (data <= 57)) / size,
        count(data == 10) * per_word,
        (size - count(~NON_BLANK_BYTES[data])) * per_word / 40,
        np.log2(words + 1) / 24,
        np.log2(np.diff(offsets) + 1) / 32,
    )
    bins = np.stack([16 * j + _share_buckets(x) for j, x in enumerate(stats)], 1)
    return np.repeat(np.arange(n), len(stats)), bins.ravel()


def term_bins(data: np.ndarray, offsets: np.ndarray, bits: int, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of every word in lower case and of word beginnings of so many bytes."""
    w = Words(LOWER[data], offsets, ALNUM_BYTES)
    rows, hashes = [w.doc], [w.hashes()]
    for k in prefixes:
        long = w.ends - w.starts > k
        rows.append(w.doc[long])
        hashes.append(w.hashed(w.starts[long], w.starts[long] + k) ^ np.uint64(0x5BD1E995 * k))
    top = np.uint64((1 << bits) - RESERVED)
    return np.concatenate(rows), (np.concatenate(hashes) % top).astype(np.int64) + RESERVED


@dataclass(frozen=True)
class Features:
    bits: int = 20
    prefixes: tuple[int, ...] = (4, 5)
    structure: bool = False

    def of(self, data: np.ndarray, offsets: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, bin) by row; a term that comes three times or more has a second bin. kept: where given, only bins with kept[bin] >= 0, and that number in place of the bin."""
        row, at = term_bins(data, offsets, self.bits, self.prefixes)
        both, times = np.unique(row << 32 | at, return_counts=True)
        often = both[times >= 3]
        many = ((often & 0xFFFFFFFF) * 0x9E3779B1 + 1) % ((1 << self.bits) - RESERVED) + RESERVED
        both = np.concatenate((both, often >> 32 << 32 | many))
        if self.structure:
            row, at = structure_bins(data, offsets)
            both = np.concatenate((both, row << 32 | at))
        if kept is not None:
            at = kept[both & 0xFFFFFFFF].astype(np.int64)
            both = (both >> 32 << 32 | at)[at >= 0]
        both = np.unique(both)
        return both >> 32, both & 0xFFFFFFFF


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label: list[Column], train, most_rows: int) -> DataFrame:
    """(label, text) of the texts of at most most_rows labelled ids, taken by the hash of the id; label: numbers from 0 to 1 from columns of labels (several: an array); train: condition on the labels' column _id.

    An id with several labels, or equal texts with several, count once, with their mean.
    """
    names = [f"_y{i}" for i in range(len(label))]
    rows = labels.select(F.col(id_col).alias("_id"), *[c.cast("double").alias(n) for c, n in zip(label, names, strict=True)]).dropna().where(train).groupBy("_id").agg(*[F.avg(n).alias(n) for n in names])
    n = rows.count()
    order = F.pmod(F.xxhash64("_id"), F.lit(1_000_000))
    # The hash leaves about 1.2 times the bound before the sort that sets it.
    picked = rows.where(order < int(1_200_000 * min(1.0, most_rows / max(n, 1))) + 1).orderBy(order, "_id").limit(most_rows)
    # At most most_rows ids and labels: the bound of this broadcast.
    texts = docs.select(F.col(id_col).alias("_did"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(picked), F.col("_did") == F.col("_id"))
    means = [F.avg(n) for n in names]
    return texts.groupBy(F.sha2("_text", 256)).agg((F.array(*means) if len(means) > 1 else means[0]).alias("label"), F.first("_text").alias("text")).select("label", "text")


@dataclass(frozen=True)
class Machine:
    features: Features
    bins: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        kept = np.full(1 << self.features.bits, -1, np.int32)
        kept[self.bins] = np.arange(len(self.bins))
        out = np.empty(len(texts))
        for a, b, data, offsets in text_runs(texts):
            row, at = self.features.of(data, offsets, kept)
            out[a:b] = sigmoid(logits(self.bias, self.weights, self.factors, row, at, b - a))
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logits(bias: float, weights: np.ndarray, factors: np.ndarray, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """bias + sum of weights + half the (square of the sum less the sum of squares) of each factor."""
    z = bias + doc_sums(weights[at], row, n)
    for f in factors.T:
        v = f[at]
        z += 0.5 * (doc_sums(v, row, n) ** 2 - doc_sums(v * v, row, n))
    return z


def train(row: np.ndarray, at: np.ndarray, y: np.ndarray, size: int, *, rank: int, epochs: int, l2: float, seed: int = 7, updates: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss by AdaGrad over batches of rows, 1/32 of them (16 to 256); row ascends. updates: where given, the rounds end after about so many, at 8 to epochs."""
    rng, n = np.random.default_rng(seed), len(y)
    batch = min(256, max(16, n // 32))
    if updates:
        epochs = min(epochs, max(8, updates * batch // max(n, 1)))
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, rank))
    bias = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    gw, gv, gb = np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2
    first = np.searchsorted(row, np.arange(n + 1))
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            docs = order[k : k + batch]
            lengths = first[docs + 1] - first[docs]
            own = np.repeat(np.arange(len(docs)), lengths)
            idx = at[np.repeat(first[docs] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())]
            sums = np.stack([doc_sums(v[idx, f], own, len(docs)) for f in range(rank)], 1)
            z = bias + doc_sums(w[idx], own, len(docs)) + 0.5 * (sums**2 - np.stack([doc_sums(v[idx, f] ** 2, own, len(docs)) for f in range(rank)], 1)).sum(1)
            d = (sigmoid(z) - y[docs]) / len(docs)
            used = np.unique(idx)
            g = np.bincount(idx, d[own], size)[used] + l2 * w[used]
            gw[used] += g * g
            w[used] -= 0.3 * g / np.sqrt(gw[used])
            for f in range(rank):
                h = np.bincount(idx, d[own] * (sums[own, f] - v[idx, f]), size)[used] + l2 * v[used, f]
                gv[used, f] += h * h
                v[used, f] -= 0.1 * h / np.sqrt(gv[used, f])
            gb += d.sum() ** 2
            bias -= 0.3 * d.sum() / np.sqrt(gb)
    return bias, w, v


def featured(sample: DataFrame, features: Features) -> DataFrame:
    """(label, bins) of a sample (label, text), stored."""

    def run(batches):
        for batch in released(batches):
            for a, b, data, offsets in text_runs(batch.column("text")):
                row, at = features.of(data, offsets)
                first = np.searchsorted(row, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(at, pa.int32()))], ["label", "bins"])

    return stored(sample.transform(in_arrow, run, f"label {sample.schema['label'].dataType.simpleString()}, bins array<int>"), "sample")


def _told(rows: DataFrame, label: Column) -> DataFrame:
    """(bin, n, z): in how many rows each bin is, and how far their labels are from all rows' (the root of the likelihood-ratio statistic, which also holds where a bin comes with one label only)."""
    total = rows.agg(F.sum(label).alias("p"), F.count("*").alias("n")).first()
    p = float(total["p"] or 0.0)
    m = float(total["n"]) - p
    counts = rows.select(label.alias("y"), F.explode("bins").alias("bin")).groupBy("bin").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where("n >= 2").withColumn("b", F.col("n") - F.col("a"))
    n, both = F.col("n"), p + m
    part = lambda x, of: F.when(x > 0, x * F.log(x * both / (n * max(of, 0.5)))).otherwise(0.0)
    return counts.select("bin", "n", F.sqrt(F.greatest(2 * (part(F.col("a"), p) + part(F.col("b"), m)), F.lit(0.0))).alias("z"))


def screened(rows: DataFrame, label: Column, *, most_bins: int, least_z: float) -> list[int]:
    """The bins that a machine is trained over, at most 1.5 * most_bins of them, by three tests over all rows (label, bins):

    the most_bins strongest of those whose own labels differ from all (z of least_z or more); up to most_bins / 4 whose
    labels differ among rows that hold one of the 64 strongest, as a term can be neutral alone and telling beside
    another; and the most frequent ones whatever their labels, one for 16 rows, up to most_bins / 6.
    """
    n = rows.count()
    told = stored(_told(rows, label), "told")
    strong = [r["bin"] for r in told.where(F.col("z") >= least_z).orderBy(F.desc("z"), "bin").limit(most_bins).collect()]
    found = set(strong) | {r["bin"] for r in told.orderBy(F.desc("n"), "bin").limit(min(most_bins // 6, n // 16)).collect()}
    if strong:
        beside = rows.where(F.arrays_overlap("bins", F.array(*[F.lit(b) for b in strong[:64]])))
        found |= {r["bin"] for r in _told(beside, label).where(F.col("z") >= least_z + 1.5).orderBy(F.desc("z"), "bin").limit(most_bins // 4).collect()}
    return sorted(found)


def fit(sample: DataFrame, features: Features, *, most_bins: int = 6000, rank: int = 6, epochs: int = 20, l2: float = 1e-4, least_z: float = 2.5, updates: int = 600) -> Machine:
    """A machine fitted on a bounded sample (label from 0 to 1, text).

    Bins are those of screened. Training is one task over them, as the sample is bounded. No rows: a machine that scores 0.5.
    """
    rows = featured(sample, features)
    if not rows.count():
        return Machine(features, np.empty(0, np.int64), 0.0, np.empty(0), np.empty((0, rank)))
    bins = np.array(screened(rows, F.col("label"), most_bins=most_bins, least_z=least_z), np.int64)

    def trained(batches):
        table = pa.Table.from_batches(list(released(batches)))
        bias, w, v = train(*placed(table.column("bins"), bins), table.column("label").to_numpy(), len(bins), rank=rank, epochs=epochs, l2=l2, updates=updates)
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([v.ravel().tolist()], pa.list_(pa.float64()))], ["bias", "w", "v"])

    # One task: the sample is bounded by most_rows of labelled_sample. Sorted, so that the result doesn't depend on the order of rows.
    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("bins"), "label").transform(in_arrow, trained, "bias double, w array<double>, v array<double>").first()
    return Machine(features, bins, one["bias"], np.array(one["w"]), np.array(one["v"]).reshape(len(bins), rank))


def placed(lists, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in bins) of what a column of lists of bins holds of bins."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    at = lists.flatten().to_numpy()
    place = np.minimum(np.searchsorted(bins, at), max(len(bins) - 1, 0))
    hit = bins[place] == at if len(bins) else np.zeros(len(at), bool)
    return row[hit], place[hit]


def scored(docs: DataFrame, machine: Machine, *, id_col: str, text_col: str) -> DataFrame:
    """(id, score) of every row; null texts count as empty."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(machine)

    def run(batches):
        for batch in released(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(batch.column(1)))], ["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).transform(in_arrow, run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def below(docs: DataFrame, machine: Machine, threshold: float, *, text_col: str) -> DataFrame:
    """docs, all columns, without the rows that score threshold or more."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in released(batches):
            yield batch.filter(pa.array(model.value.scores(batch.column(place)) < threshold))

    return docs.transform(in_arrow, run, docs.schema)

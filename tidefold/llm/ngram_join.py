"""N-gram Jaccard join: MinHash candidates pruned by a Bayesian posterior as hashes are compared, the rest verified exactly."""

from __future__ import annotations

import hashlib
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import NON_BLANK_BYTES, Words, digest, in_arrow, kept_rows, looked_up, mixed, released, stored, text_runs

BANDS, ROWS = 28, 5
_HASHES = BANDS * ROWS
_MULTIPLY = np.random.default_rng(5).integers(0, 2**31, _HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = np.random.default_rng(6).integers(0, 2**32, _HASHES, dtype=np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each row and one more): the distinct runs of n words of each text, ascending; of fewer words the one run of all."""
    w = Words(data, offsets, NON_BLANK_BYTES)
    h, count = w.hashes(), np.diff(w.first)
    runs = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    start = np.repeat(w.first[:-1] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
    row = np.repeat(np.arange(len(count)), runs)
    out = np.zeros(len(start), np.uint64)
    last = np.repeat(w.first[1:], runs)
    for j in range(n):
        at = start + j
        inside = at < last
        out[inside] = mixed(out[inside] * np.uint64(0x9E3779B97F4A7C15) + h[at[inside]] + np.uint64(j))
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], np.searchsorted(row[new], np.arange(len(count) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each text; texts without shingles get the largest value."""
    out = np.full((len(first) - 1, _HASHES), 0xFFFFFFFF, np.uint32)
    low = (hashes >> np.uint64(16)).astype(np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        edges = first[some]
        for k in range(_HASHES):
            out[some, k] = np.minimum.reduceat(low * _MULTIPLY[k] + _ADD[k], edges)
    return out


def buckets(sig: np.ndarray) -> np.ndarray:
    """A bucket for each band of each signature: 64-bit hashes of the band's number and values."""
    wide = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), wide.shape[:2]).copy()
    for j in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, j] + np.uint64(1))
    return out


def least_matches(threshold: float, tolerance: float, steps: tuple[int, ...]) -> list[int]:
    """For each number of compared hashes, the fewest matches at which the posterior probability (uniform prior) that the similarity reaches threshold is tolerance at least."""
    grid = np.linspace(0.0005, 0.9995, 1000)
    out = []
    for n in steps:
        for m in range(n + 1):
            density = np.exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(grid) + (n - m) * np.log1p(-grid))
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                break
        out.append(m)
    return out


STEPS = (20, 40, 80, _HASHES)


def pruned(left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Places of the pairs (rows of left and right) that stay possible as ever more hashes are compared."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in zip(STEPS, least_matches(threshold, tolerance, STEPS), strict=True):
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(1)
        stay = matches >= least
        alive, matches, done = alive[stay], matches[stay], n
    return alive


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def linked(sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs of a block that reach threshold: all pairs if side is 0, else of side 1 with side 2."""
    size = np.array([len(s) for s in sets])
    a = np.flatnonzero(side != 2)
    b = np.flatnonzero(side != 1)
    steps = least_matches(threshold, tolerance, STEPS)
    found = []
    for lo in range(0, len(a), 128):
        part = a[lo : lo + 128]
        ok = np.minimum(size[part, None], size[b]) >= threshold * np.maximum(size[part, None], size[b]) - 1e-9
        if not side.any():
            ok &= part[:, None] < b
        i, j = np.nonzero(ok)
        equal = np.zeros((len(part), len(b)), np.int16)
        for k in range(STEPS[0]):
            equal += sig[part, k][:, None] == sig[b, k]
        keep = equal[i, j] >= steps[0]
        i, j = part[i[keep]], b[j[keep]]
        for c in range(0, len(i), 50_000):
            stay = pruned(sig[i[c : c + 50_000]], sig[j[c : c + 50_000]], threshold, tolerance)
            found.append(np.stack((i[c : c + 50_000][stay], j[c : c + 50_000][stay])))
    pairs = np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)
    shared = _shared(sets, pairs)
    good = shared >= threshold * (size[pairs[0]] + size[pairs[1]] - shared) - 1e-9
    return pairs[0][good], pairs[1][good]


def _shared(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """How many shingles the sets of each pair share: pair by pair, or by products of 0/1 matrices where there are many pairs."""
    if pairs.shape[1] <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs.T], np.int64)
    used = np.unique(pairs)
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, at, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    common = count >= 2
    place = np.cumsum(common) - 1
    row, at = row[common[at]], place[at[common[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    total = np.zeros((len(used), len(used)), np.float32)
    for lo in range(0, int(common.sum()), 2048):
        a, b = np.searchsorted(at, (lo, lo + 2048))
        x = np.zeros((len(used), 2048), np.float32)
        x[row[a:b], at[a:b] - lo] = 1
        total += x @ x.T
    return np.rint(total[np.searchsorted(used, pairs[0]), np.searchsorted(used, pairs[1])]).astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, name: str) -> DataFrame:
    """(v, root) of all ends of edges (a, b): root is the smallest end that is joined with v. Labels spread and jump until none changes; every round is written to the shared folder.

    Both joins of a round have one row for each key on their right, so where a hub of many edges or a label of many ends
    makes one key large, Spark's adaptive skew join splits the left side of that key.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("root")), f"{name}-labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("root").alias("near"))
        least = labels.join(near, labels["v"] == near["a"], "left").select("v", "root", F.least("root", "near").alias("low"))
        step = stored(least, f"{name}-step")
        jump = step.select(F.col("v").alias("w"), F.col("low").alias("far"))
        labels = stored(step.join(jump, step["low"] == jump["w"], "left").select("v", F.least("low", "far").alias("root"), (F.least("low", "far") < F.col("root")).alias("changed")), f"{name}-labels")
        if not labels.where("changed").limit(1).count():
            return labels.select("v", "root")


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, tolerance: float = 1e-4, small_bucket: int = 24, block: int = 512, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(_id, _digest, _kept, class_id, n_links) for each row of docs; see near_duplicates and keep_one_of_each."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), digest(F.col(text_col)).alias("_digest"))
    split = f"_id {kind}, _digest struct<a:bigint,b:int>"

    def signed(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in released(batches):
            for a, b, data, offsets in text_runs(batch.column(1)):
                hashes, first = shingles(data, offsets, words)
                sig = signatures(hashes, first)
                raw = data.tobytes()
                keys = [hashlib.blake2b(b" ".join(raw[x:y].split()), digest_size=16).digest() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel().view(t))) for x, t in ((sig, np.int32), (buckets(sig), np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(row + np.arange(a, b)), pa.array(keys, pa.binary()), pa.array(np.diff(first), pa.int32()), *lists], ["_id", "_digest", "row", "key", "n", "sig", "buckets"])
            row += len(batch)

    every = stored(base.transform(in_arrow, signed, f"{split}, row bigint, key binary, n int, sig array<int>, buckets array<bigint>"), "signatures")
    # Equal word sequences become one text, named by the row with the smallest id (null last), then the smallest row number.
    first_of = F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("row").alias("row")))
    texts = stored(every.where("n > 0").groupBy("key").agg(first_of.alias("first"), F.count("*").alias("copies")).withColumn("rep", F.col("first.row")), "texts")
    reps = stored(every.join(texts.select("rep", "copies"), F.col("row") == F.col("rep")).select("rep", "_id", "_digest", "copies", "n", "sig", "buckets"), "representatives")

    bands = reps.select("rep", F.explode("buckets").alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("members"), F.min("rep").alias("least")).where("members > 1")
    hits = stored(bands.join(sizes, "bucket"), "buckets")
    few = hits.where(F.col("members") <= small_bucket).select("bucket", "rep")
    pairs = few.select("bucket", F.col("rep").alias("a")).join(few.select("bucket", F.col("rep").alias("b")), "bucket").where("a < b").groupBy("a", "b").agg(F.lit(1).alias("_"))
    with_sigs = pairs.join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a").join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")
    with_sigs = with_sigs.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9).select("a", "b", "sa", "sb")

    def possible(batches):
        for batch in released(batches):
            for lo in range(0, len(batch), 20_000):
                part = batch.slice(lo, 20_000)
                stay = pa.array(pruned(_matrix(part.column(2), _HASHES), _matrix(part.column(3), _HASHES), threshold, tolerance))
                yield pa.RecordBatch.from_arrays([part.column(0).take(stay), part.column(1).take(stay)], ["a", "b"])

    small = with_sigs.transform(in_arrow, possible, "a bigint, b bigint")
    large = hits.where(F.col("members") > small_bucket).select(F.col("rep").alias("a"), F.col("least").alias("b"))
    candidates = components(small.union(large), "candidates")

    # Blocks of each candidate component. A large one is split by size class (a pair's classes are equal or neighbours) and by hash.
    group = stored(candidates.join(reps, candidates["v"] == reps["rep"]).select("rep", "root", "_id", "_digest", "copies", "n", "sig", F.floor(F.log(F.col("n").cast("double")) / -log(threshold)).cast("int").alias("_class")), "candidate-texts")
    by_class = group.groupBy("root", "_class").agg(F.count("*").alias("_c"), F.sum("n").alias("_cs"))
    totals = by_class.groupBy("root").agg(F.sum("_c").alias("_m"), F.sum("_cs").alias("_s"))
    split_up = (F.col("_m") > block) | (F.col("_s") > 4096 * block)
    parts = stored(by_class.join(totals, "root").where(split_up).select("root", "_class", F.ceil(F.greatest(F.col("_c") / block, F.col("_cs") / (4096 * block))).cast("int").alias("parts"), "_c"), "parts")
    after = parts.select("root", (F.col("_class") - 1).alias("_class"), F.col("parts").alias("up"))
    before = parts.select("root", (F.col("_class") + 1).alias("_class"), F.col("parts").alias("down"))
    plan = parts.join(after, ["root", "_class"], "left").join(before, ["root", "_class"], "left").na.fill(0, ["up", "down"])
    # A large component is one key here, so its classes' plans are found by looked_up.
    plan = stored(plan.select(F.struct("root", "_class").alias("_place"), "parts", "up", "down", "_c"), "plan")
    placed = looked_up(group.withColumn("_place", F.struct("root", "_class")), plan, "_place", "_c", group.count())
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")

    def task(c1, h1, c2, h2, side):
        return F.struct(F.concat_ws("/", c1.cast("string"), h1.cast("string"), c2.cast("string"), h2.cast("string")).alias("task"), side.cast("int").alias("side"))

    c = F.col("_class")
    same = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda h: task(c, F.least(own, h), c, F.greatest(own, h), F.when(own == h, 0).when(own < h, 1).otherwise(2)))
    up = F.when(F.col("up") > 0, F.transform(F.sequence(F.lit(0), F.col("up") - 1), lambda h: task(c, own, c + 1, h, F.lit(1)))).otherwise(F.array().cast("array<struct<task:string,side:int>>"))
    down = F.when(F.col("down") > 0, F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda h: task(c - 1, h, c, own, F.lit(2)))).otherwise(F.array().cast("array<struct<task:string,side:int>>"))
    tasks = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit("").alias("task"), F.lit(0).alias("side")))).otherwise(F.concat(same, up, down))
    ids = group.select(F.col("rep").alias("_rep"), F.col("_id").alias("_rid"), F.col("_digest").alias("_rd"))
    fewer = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    wanted = base.join(F.broadcast(ids) if fewer else ids, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_digest") == F.col("_rd"))).select("_rep", "_text")

    def sets(batches):
        for batch in released(batches):
            for a, b, data, offsets in text_runs(batch.column(1)):
                hashes, first = shingles(data, offsets, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64)))], ["_rep", "hashes"])

    # Rows equal in id and text come several times, with the same set.
    exact = wanted.transform(in_arrow, sets, "_rep bigint, hashes array<bigint>")
    repeated = bool(every.groupBy("_id", "_digest").count().where("count > 1").limit(1).count())
    exact = stored(exact.groupBy("_rep").agg(F.first("hashes").alias("hashes")) if repeated else exact, "sets")
    work = placed.join(exact, F.col("rep") == F.col("_rep")).select("root", "rep", "copies", "sig", "hashes", F.explode(tasks).alias("t"))
    work = work.select("root", F.col("t.task").alias("task"), F.col("t.side").alias("side"), "rep", "copies", "sig", "hashes")

    def blocks(batches):
        held, key = [], None
        for batch in released(batches):
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            lo = 0
            while lo < len(batch):
                hi = lo + 1
                while hi < len(batch) and keys[hi] == keys[lo]:
                    hi += 1
                if held and keys[lo] != key:
                    yield from solved(held)
                    held = []
                key = keys[lo]
                held.append(batch.slice(lo, hi - lo))
                lo = hi
        if held:
            yield from solved(held)

    def solved(held):
        t = pa.Table.from_batches(held)
        if len(t) < 2:
            return
        sig = _matrix(t.column("sig"), _HASHES)
        lists = t.column("hashes").combine_chunks()
        flat, edge = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        each = [np.sort(flat[x:y].view(np.uint64)) for x, y in zip(edge[:-1], edge[1:], strict=True)]
        i, j = linked(sig, each, t.column("side").to_numpy(), threshold, tolerance)
        if len(i):
            copies, m = t.column("copies").to_numpy().astype(float), len(t)
            links = np.bincount(i, copies[j], m) + np.bincount(j, copies[i], m)
            hit, root = np.flatnonzero(links), _roots(m, i, j)
            rep = t.column("rep").combine_chunks()
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(hit)), rep.take(pa.array(root[hit])), pa.array(links[hit].astype(np.int64))], ["a", "b", "links"])

    found = stored(work.repartition("root", "task").sortWithinPartitions("root", "task").transform(in_arrow, blocks, "a bigint, b bigint, links bigint"), "links")
    classes = components(found, "classes")
    links = found.groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("_links"))
    named = texts.join(links, texts["rep"] == links["_a"], "left").join(classes, texts["rep"] == classes["v"], "left")
    named = stored(named.select("key", "first", "copies", F.coalesce("root", "rep").alias("root"), (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    # The first row of each class. A class of many texts is one key for the lookup of its texts, a text of many copies for that of its rows.
    firsts = stored(named.groupBy("root").agg(F.min("first").alias("class"), F.count("*").alias("_texts")), "classes")
    total = every.count()
    named = stored(looked_up(named, firsts, "root", "_texts", total).select("key", "copies", "class", "n_links"), "named-texts")
    out = looked_up(every.select("_id", "_digest", "row", F.when(F.col("n") > 0, F.col("key")).alias("key")), named, "key", "copies", total)
    return out.select(
        "_id", "_digest", F.coalesce(F.col("row") == F.col("class.row"), F.lit(True)).alias("_kept"),
        F.when(F.col("class").isNull(), F.col("_id")).otherwise(F.col("class.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, **options) -> DataFrame:
    """One row for each row of docs: id, class_id, n_links. options: tolerance, small_bucket, block, broadcast_ids.

    Two texts are linked if the Jaccard similarity of their distinct runs of words (split at blanks, case kept) is
    threshold or more; a text of fewer words has one run of all. class_id is the smallest id that is connected by links
    or equal word sequences, n_links the number of other documents linked with this one, equal ones included.

    Texts of equal words are first merged. MinHash values (140) make 28 buckets for each text; a pair of similarity 0.8
    shares none with probability 2e-5. In buckets of at most small_bucket (24) texts pairs are compared hash by hash and
    dropped when the posterior probability of reaching threshold falls below tolerance (1e-4). What stays connected, with
    all members of larger buckets, is compared in blocks of about block (512) texts, pruned likewise, and verified on the
    exact sets: a large group is split over many tasks, which return counts and a local root for each text, never pairs.
    No link is capped.

    Texts without words (null ones too) have no links and are their own class. Rows are told apart by number, so rows
    that repeat an id, with the same text or another, are each compared; a null id is never a class_id unless a whole
    class has no other. Other columns are not read. No rows: no rows.
    """
    found = near_classes(docs, id_col=id_col, text_col=text_col, words=words, threshold=threshold, **options)
    return found.select(F.col("_id").alias(id_col), "class_id", "n_links")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, one row of each class of near_duplicates: that with the smallest id.

    Null ids come last, and of equal ids one row stays. Each text without words stays. Options as in near_duplicates. No
    rows: no rows.
    """
    found = near_classes(docs, id_col=id_col, text_col=text_col, **options)
    return kept_rows(docs, found.select("_id", "_digest", "_kept"), id_col=id_col, text_col=text_col)

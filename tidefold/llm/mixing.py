"""Soft-membership mixing: domain posteriors from a classifier fitted on the labels table, and nonnegative document rates by projected gradient."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm import factorisation as fm
from tidefold.llm.common import NON_BLANK_BYTES, Words, digest, in_arrow, kept_rows, looked_up, released, stored, text_runs

FEATURES = fm.Features(bits=20, prefixes=(4, 5), structure=True)
LABELS = ("quality", "toxic")
DOMAINS = tuple(product((0, 1), repeat=len(LABELS)))
#: Shares of the mixture's tokens by domain (values of the labels), and the domain that is to be used once in full.
TARGETS = {(1, 0): 0.90, (0, 0): 0.06, (1, 1): 0.04}
ANCHOR = (1, 0)
RANK = 4


def name(domain: tuple[int, ...]) -> str:
    return "p_" + "_".join(f"{c}{v}" for c, v in zip(LABELS, domain, strict=True))


def fit_domains(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, most_rows: int) -> list[fm.Machine]:
    """A machine for each of DOMAINS against the others, all on one sample of at most most_rows labelled rows; none without labels."""
    inside = []
    for d in DOMAINS:
        hit = F.lit(True)
        for c, v in zip(LABELS, d, strict=True):
            hit = hit & (F.col(c) == v)
        inside.append(hit)
    rows = fm.featured(fm.labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label=inside, train=F.lit(True), most_rows=most_rows), FEATURES)
    if not rows.count():
        return []
    bins = [np.array(fm.screened(rows, F.get("label", F.lit(k)), most_bins=3000, least_z=2.5), np.int64) for k in range(len(DOMAINS))]

    def trained(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("order").to_numpy(), kind="stable")))
        k = table.column("domain")[0].as_py()
        bias, w, v = fm.train(*fm.placed(table.column("bins"), bins[k]), table.column("y").to_numpy(), len(bins[k]), rank=RANK, epochs=12, l2=1e-4, updates=500)
        return pa.table({"domain": pa.array([k], pa.int32()), "bias": [bias], "w": pa.array([w.tolist()], pa.list_(pa.float64())), "v": pa.array([v.ravel().tolist()], pa.list_(pa.float64()))})

    # Each group is the sample, which most_rows bounds.
    each = rows.select(F.posexplode("label").alias("domain", "y"), "bins", F.xxhash64("bins", "label").alias("order"))
    got = {r["domain"]: r for r in each.groupBy("domain").applyInArrow(trained, "domain int, bias double, w array<double>, v array<double>").collect()}
    return [fm.Machine(FEATURES, bins[k], got[k]["bias"], np.array(got[k]["w"]), np.array(got[k]["v"]).reshape(len(bins[k]), RANK)) for k in range(len(DOMAINS))]


def posteriors(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 12_000) -> DataFrame:
    """(_id, _digest, n_tokens, p): words of each text, and the posterior of each of DOMAINS, to four digits.

    A domain is a value of each label. Of each domain a machine tells its rows from all others; the posteriors are these
    scores as shares of their sum. Without labels they are equal.
    """
    machines = fit_domains(docs, labels, id_col=id_col, text_col=text_col, most_rows=most_rows)
    k = len(DOMAINS)
    bins = np.unique(np.concatenate([m.bins for m in machines])) if machines else np.empty(0, np.int64)
    model = docs.sparkSession.sparkContext.broadcast((bins, [(m.bias, np.searchsorted(bins, m.bins), m.weights, m.factors) for m in machines]))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bins, parts = model.value
        kept = np.full(1 << FEATURES.bits, -1, np.int32)
        kept[bins] = np.arange(len(bins))
        wide = []
        for bias, place, w, v in parts:
            weights, factors = np.zeros(len(bins)), np.zeros((len(bins), v.shape[1]))
            weights[place], factors[place] = w, v
            wide.append((bias, weights, factors))
        for batch in released(batches):
            for a, b, data, offsets in text_runs(batch.column(2)):
                row, at = FEATURES.of(data, offsets, kept) if wide else (None, None)
                score = np.stack([fm.sigmoid(fm.logits(*m, row, at, b - a)) for m in wide], 1) if wide else np.ones((b - a, k))
                p = np.round(score / score.sum(1, keepdims=True), 4)
                # The largest takes what rounding leaves.
                p[np.arange(b - a), p.argmax(1)] += 1 - p.sum(1)
                p = np.round(p, 4)
                words = np.diff(Words(data, offsets, NON_BLANK_BYTES).first)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(words.astype(np.int64)), lists], ["_id", "_digest", "n_tokens", "p"])

    return docs.select(F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("_digest"), F.col(text_col).alias("_text")).transform(in_arrow, run, f"_id {kind}, _digest struct<a:bigint,b:int>, n_tokens bigint, p array<double>")


def _dot(values: Column, numbers: list[float]) -> Column:
    """The sum of products. The numbers are one constant array, so Spark compiles a round's expressions once and not anew for every round's numbers."""
    return F.aggregate(F.zip_with(values, F.array(*[F.lit(float(x)) for x in numbers]), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def fit_rates(table: DataFrame, targets: list[float], *, most_rate: float | None = None, pull: float = 1e-3, rounds: int = 120, settled: float = 1e-4) -> DataFrame:
    """table (n_tokens, p, more; stored) with rate: nonnegative rates, at most most_rate, whose expected tokens of each domain come nearest to targets.

    Minimises the sum of squared gaps, each over the domain's tokens at rate 1, plus pull times the token-weighted square
    distance of the rates from 1, by accelerated projected gradient. Rows of equal posteriors have equal rates, so they
    are first added up. A round sums rate * n_tokens * p over these groups and moves every rate; only the sums, a few
    numbers for each domain, come to the driver. It ends when no rate would move by more than settled (token-weighted
    mean), which is the optimum's own condition, or when every domain is within settled of its target. Rows with an
    empty p or null tokens count as none.
    """
    k = len(targets)
    groups = stored(table.groupBy("p").agg(F.sum("n_tokens").alias("_n"), F.count("*").alias("_rows"), F.lit(1.0).alias("_x"), F.lit(1.0).alias("_y")), "rate-groups")
    share = [F.get("p", F.lit(d)) for d in range(k)]
    full = [float(x or 0.0) for x in groups.agg(*[F.sum(F.col("_n") * s) for s in share]).first()]
    rows, total = groups.agg(F.sum("_rows")).first()[0] or 0, sum(full)
    if not total:
        return table.withColumn("rate", F.lit(1.0))
    scale = [max(f, 1e-6 * total) for f in full]
    # A bound of the curvature: the rows of the matrix of shares over scales sum to 1 at most in each domain.
    step, momentum = 1 / (1 + pull), 1.0
    bounded = lambda c: F.greatest(F.lit(0.0), c if most_rate is None else F.least(F.lit(float(most_rate)), c))
    for n in range(rounds):
        # _y: where the gradient is taken; _x: the rates. The sums at _y and how far the last step went.
        now = groups.agg(*[F.sum(F.col("_n") * s * F.col("_y")) for s in share]).first()
        gap = [(float(x or 0.0) - t) / f for x, t, f in zip(now, targets, scale, strict=True)]
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = (momentum - 1) / after
        pushed = F.col("_y") * (1 - step * pull) + step * pull - _dot(F.col("p"), [step * g for g in gap])
        groups = groups.withColumn("_new", bounded(pushed))
        groups = groups.select("p", "_n", "_rows", F.col("_new").alias("_x"), _dot(F.array("_new", "_x"), [1 + ahead, -ahead]).alias("_y"), F.abs(F.col("_new") - F.col("_y")).alias("_moved"))
        momentum = after
        if n % 8 == 7:
            groups = stored(groups, "rate-groups")
            seen = groups.agg(F.sum(F.col("_n") * F.col("_moved")), *[F.sum(F.col("_n") * s * F.col("_x")) for s in share]).first()
            if float(seen[0] or 0.0) <= settled * total or all(abs(float(x) - t) <= settled * max(t, settled * total) for x, t in zip(seen[1:], targets, strict=True)):
                break
    rates = stored(groups.select("p", "_rows", F.col("_x").alias("rate")), "rates")
    return looked_up(table, rates, "p", "_rows", rows).select(*table.columns, "rate")


def mixture(docs: DataFrame, labels: DataFrame, *, targets: dict[tuple[int, ...], float] = TARGETS, anchor: tuple[int, ...] = ANCHOR, most_rate: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_tokens, a posterior column for each domain, rate.

    Targets are shares of the mixture's tokens; its size is such that the anchor domain's expected tokens are used once.
    Domains without a target get 0. Null and empty texts have no tokens and the rate of their posteriors; null ids stay;
    repeated rows count each; without labels all posteriors are equal. Extra columns are not read. No rows: no rows.
    """
    fitted = _fitted(docs, labels, targets=targets, anchor=anchor, most_rate=most_rate, id_col=id_col, text_col=text_col)
    return fitted.select(F.col("_id").alias(id_col), "n_tokens", *[F.get("p", F.lit(i)).alias(name(d)) for i, d in enumerate(DOMAINS)], "rate")


def _fitted(docs: DataFrame, labels: DataFrame, *, targets: dict, anchor: tuple[int, ...], most_rate: float | None, id_col: str, text_col: str) -> DataFrame:
    table = stored(posteriors(docs, labels, id_col=id_col, text_col=text_col), "posteriors")
    anchored = table.agg(F.sum(F.col("n_tokens") * F.get("p", F.lit(DOMAINS.index(anchor))))).first()[0] or 0.0
    return fit_rates(table, [targets.get(d, 0.0) * anchored / targets[anchor] for d in DOMAINS], most_rate=most_rate)


def shares(mixed: DataFrame, targets: dict[tuple[int, ...], float] = TARGETS) -> DataFrame:
    """A row for each domain of a mixture: its target share, the share that its expected tokens reach, and the tokens' own share at rate 1.

    Where a target isn't reached, its tokens at rate 1 are too few for the bound on rates, or its documents are
    members of other domains too.
    """
    used = mixed.agg(*[F.sum(F.col(name(d)) * F.col("n_tokens") * F.col("rate")).alias(f"u{i}") for i, d in enumerate(DOMAINS)], *[F.sum(F.col(name(d)) * F.col("n_tokens")).alias(f"a{i}") for i, d in enumerate(DOMAINS)])
    whole = lambda c: sum((F.col(f"{c}{i}") for i in range(1, len(DOMAINS))), F.col(f"{c}0"))
    each = [F.struct(F.lit(name(d)).alias("domain"), F.lit(float(targets.get(d, 0.0))).alias("target"), (F.col(f"u{i}") / whole("u")).alias("reached"), (F.col(f"a{i}") / whole("a")).alias("available")) for i, d in enumerate(DOMAINS)]
    return used.select(F.explode(F.array(*each)).alias("s")).select("s.*")


def mix(docs: DataFrame, labels: DataFrame, *, targets: dict[tuple[int, ...], float] = TARGETS, anchor: tuple[int, ...] = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, each row kept with the probability of its rate (at most 1) by the hash of its id and text.

    Each row is judged by its own text: rows equal in id and text stay or go together, null ids are judged like others.
    Ties and nulls as in mixture. No rows: no rows.
    """
    rates = _fitted(docs, labels, targets=targets, anchor=anchor, most_rate=1.0, id_col=id_col, text_col=text_col)
    chance: Column = F.pmod(F.xxhash64(F.lit("mix"), F.col("_id"), F.col("_digest")), F.lit(1_000_000)) / 1_000_000
    return kept_rows(docs, rates.select("_id", "_digest", (chance < F.col("rate")).alias("_kept")), id_col=id_col, text_col=text_col)

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import WORD, lower
from pyspark.sql import functions as F

from tidefold.llm import factorisation as fm
from tidefold.llm.language_id import language_query, language_spans, viterbi
from tidefold.llm.lattice_lm import lattice_lm, lattice_query, lattice_scores, vocabulary
from tidefold.llm.mixing import TARGETS, fit_rates, mix, mixture, shares
from tidefold.llm.quality import quality
from tidefold.llm.toxicity import drop_toxic, toxicity

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet").cache(), spark.read.parquet(f"{BIG}/labels.parquet").cache()


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def held_out(rows, want, threshold):
    """(recall of label 1, share of label 0 that is left alone) in the held-out fold."""
    hit = [(r["score"] >= threshold) for r in rows if r["held_out"] and want.get(r["doc_id"]) == 1]
    clean = [(r["score"] < threshold) for r in rows if r["held_out"] and want.get(r["doc_id"]) == 0]
    return np.mean(hit), np.mean(clean)


def test_toxicity(big):
    docs, labels = big
    rows = toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    found, clean = held_out(rows, {r["doc_id"]: r["toxic"] for r in labels.collect()}, 0.3)
    assert found >= 0.75 and clean >= 0.97
    left = drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(r["score"] < 0.3 for r in rows)


def test_quality(big):
    docs, labels = big
    rows = quality(docs, labels).collect()
    found, clean = held_out(rows, {r["doc_id"]: r["quality"] for r in labels.collect()}, 0.7)
    assert found >= 0.95 and clean >= 0.8
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


@pytest.mark.parametrize("scorer", [toxicity, quality])
def test_scores_awkward(awkward, nothing, labels, spark, scorer):
    some = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (8, None, None), (None, 1, 1), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
    for marks in (some, labels.limit(0)):
        rows = scorer(awkward, marks).collect()
        assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in scorer(awkward, labels.limit(0)).collect()} == {0.5}
    assert scorer(nothing, some).count() == 0


def test_machine_learns_a_pair_that_no_sum_of_weights_can():
    """Label 1 where exactly both or neither of two terms come: the pair's factor decides."""
    rng = np.random.default_rng(0)
    rows = [(i, (i // 2) % 2, i % 2) for i in range(400)]
    row = np.concatenate([[i] * (1 + a + b) for i, a, b in rows])
    at = np.concatenate([[0] + [1] * a + [2] * b for i, a, b in rows])
    y = np.array([float(a == b) for _, a, b in rows])
    bias, w, v = fm.train(row, at, y, 3, rank=4, epochs=60, l2=1e-6)
    z = fm.logits(bias, w, v, row, at, len(rows))
    assert ((z > 0) == (y == 1)).mean() == 1.0
    direct = bias + np.array([sum(w[i] for i in at[row == r]) + sum(v[i] @ v[j] for k, i in enumerate(at[row == r]) for j in at[row == r][k + 1 :]) for r in range(20)])
    assert np.allclose(z[:20], direct) and rng is not None


def test_language(big):
    docs, _ = big
    rows = language_query(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in rows) and np.mean(out) >= 0.97


def test_language_spans_of_mixed_text(spark, big):
    docs, _ = big
    by = {r["lang"]: r["text"] for r in docs.where("length(text) > 400").collect()}
    mixed = by["en"][:300] + "\n" + by["de"][:300]
    train = docs.unionByName(spark.createDataFrame([(10**9, mixed, None, "x", 1)], docs.schema))
    got = language_spans(train).where("doc_id = 1000000000").first()
    assert [s["lang"] for s in got["spans"]][0] == "en" and got["spans"][-1]["lang"] == "de" and len(got["spans"]) <= 4


def test_viterbi_equals_trying_all():
    rng = np.random.default_rng(3)
    first = np.array([0, 1, 6, 6, 10])
    scores = rng.normal(size=(10, 3)) * 3
    got = viterbi(scores, first, 2.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        best, arg = -np.inf, None
        for code in range(3 ** (b - a)):
            path = [(code // 3**k) % 3 for k in range(b - a)]
            value = sum(scores[a + k, s] for k, s in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))
            if value > best:
                best, arg = value, path
        if b > a:
            assert got[a:b].tolist() == arg


def test_script_narrows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("кот сидел на ковре", "ru"), ("le chat est sur le tapis", "fr")] * 30)]
    docs = spark.createDataFrame(rows + [(500, "ковре the", None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in language_spans(docs).collect()}
    assert got[1]["lang_pred"] == "ru" and got[0]["lang_pred"] == "en" and [s["lang"] for s in got[500]["spans"]] == ["ru", "en"]


def test_language_awkward(awkward, nothing):
    got = {r["doc_id"]: r for r in language_query(awkward).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[4]["lang_pred"] != "und"
    assert language_query(awkward).count() == awkward.count() and language_query(nothing).count() == 0
    alone = language_spans(awkward, train=F.lit(False)).collect()
    assert {r["lang_pred"] for r in alone} == {"und"}


def test_lattice_sums_all_segmentations():
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    _, pieces, prior = vocabulary(path)
    with np.errstate(divide="ignore"):
        logp = np.log(prior)
    value = Counter()
    for p, q in zip(pieces, prior, strict=True):
        if p:
            value[p] += q

    def total(word: bytes) -> float:
        ways = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            ways[j] = sum(ways[i] * value[word[i:j]] for i in range(j))
        return ways[-1]

    words = ["the", "segmentation", "zz", "é", "日本", "a" * 70, "x-1_y", "\U0001f600"]
    got = lattice_scores([w.encode() for w in words], logp, path)
    assert np.allclose(got, [math.log(total(("▁" + w).encode())) for w in words])


def test_lattice_lm_base(big):
    docs, _ = big
    rows = {r["doc_id"]: r for r in lattice_query(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = Counter()
    for i, t in texts.items():
        if fold(i, 5) != 1:
            counts.update(WORD.findall(lower(t)))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        tokens, r = [*WORD.findall(lower(t)), None], rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n, fold(i, 5) == 1)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel_tol=1e-9)
        assert r["score"] < 0


def test_lattice_lm_prefers_the_corpus(big, spark):
    docs, _ = big
    two = docs.unionByName(spark.createDataFrame([(10**9, "qzx jjk vvw xqz kkj zzx qqv", "en", "x", 1), (10**9 + 1, "the of and in that with was", "en", "x", 1)], docs.schema))
    got = {r["doc_id"]: r["score"] for r in lattice_lm(two, train=F.col("_id") < 10**9).where("doc_id >= 1000000000").collect()}
    assert got[10**9 + 1] > got[10**9] + 5


def test_lattice_lm_awkward(awkward, nothing):
    got = lattice_query(awkward).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == awkward.count() and by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 1 and by[8]["n_tokens"] == 30_001
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert lattice_query(nothing).count() == 0
    untrained = lattice_lm(awkward, train=F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in untrained)


def test_rates_reach_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n), p.tolist()) for i, (n, p) in enumerate(zip(rng.integers(10, 500, 400), rng.dirichlet([0.3, 0.3, 0.3], 400), strict=True))]
    table = spark.createDataFrame(rows, "_id bigint, n_tokens bigint, p array<double>")
    total = np.sum([np.array(p) * n for _, n, p in rows], axis=0)
    target = total * [1.2, 0.8, 0.9]
    got = fit_rates(table, target.tolist()).collect()
    sums = np.sum([np.array(r["p"]) * r["n_tokens"] * r["rate"] for r in got], axis=0)
    assert all(r["rate"] >= 0 for r in got) and np.allclose(sums, target, rtol=0.01)
    # The closed form of the same minimum without the bound: rates fall linearly along the posteriors.
    capped = fit_rates(table, target.tolist(), most_rate=1.0).collect()
    assert all(0 <= r["rate"] <= 1 for r in capped)


def test_mixture(big):
    docs, labels = big
    got = mixture(docs, labels).toPandas()
    names = [c for c in got.columns if c.startswith("p_")]
    assert len(got) == docs.count() and (got.rate >= 0).all() and np.allclose(got[names].sum(1), 1)
    used = {c: (got[c] * got.n_tokens * got.rate).sum() for c in names}
    share = used["p_quality1_toxic0"] / sum(used.values())
    assert abs(share - TARGETS[(1, 0)]) < 0.03


def test_mix_keeps_good_documents(big):
    """Good documents stay, toxic ones (no target) go, and the shares come near the targets or as near as the poor ones' supply lets them."""
    docs, labels = big
    targets = {(1, 0): 0.92, (0, 0): 0.08}
    kept = mix(docs, labels, targets=targets)
    marks = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    left = {r["doc_id"] for r in kept.collect()}
    stay = lambda d: np.mean([i in left for i, m in marks.items() if m == d])
    assert kept.columns == docs.columns and stay((1, 0)) >= 0.99 and stay((0, 1)) <= 0.25 and stay((1, 1)) <= 0.25
    got = {r["domain"]: r for r in shares(mixture(docs, labels, targets=targets, most_rate=1.0), targets).collect()}
    for domain, r in got.items():
        assert abs(r["reached"] - r["target"]) <= 0.03 or r["available"] < r["target"], (domain, r)


def test_mixture_awkward(awkward, nothing, labels):
    some = labels.limit(0)
    got = mixture(awkward, some).collect()
    assert len(got) == awkward.count() and all(r["rate"] >= 0 for r in got)
    assert mixture(nothing, some).count() == 0 and mix(nothing, some).count() == 0
    assert mix(awkward, some).columns == awkward.columns

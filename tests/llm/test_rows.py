"""Rows with null and repeated ids, many languages, texts without letters, balance of step groups, exact quantiles."""

import numpy as np
from brute import near_classes

from tidefold.llm.exact_dedup import drop_exact_duplicates
from tidefold.llm.language_id import language_spans
from tidefold.llm.ngram_join import keep_one_of_each
from tidefold.llm.packing import Steps, cost, packed
from tidefold.llm.quality_rules import METRICS, TIE, quality_rules
from tidefold.llm.secret_scan import secret_scan

ROWS = [(1, "A a a"), (None, "A a a"), (None, "B b b"), (6, "A a a"), (6, "C c c"), (6, "C c c"), (None, "D d d"), (None, "D d d")]


def test_no_unique_text_is_dropped_with_its_id(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    for drop in (drop_exact_duplicates, keep_one_of_each):
        left = sorted((r["doc_id"] or 0, r["text"]) for r in drop(docs).collect())
        assert left == [(0, "B b b"), (0, "D d d"), (1, "A a a"), (6, "C c c")], drop


def test_dropping_beyond_the_broadcast_bound(spark, documents, monkeypatch):
    from tidefold.llm import common

    want = {r["doc_id"] for r in drop_exact_duplicates(documents).collect()}
    monkeypatch.setattr(common, "MOST_SENT", 0)
    assert {r["doc_id"] for r in drop_exact_duplicates(documents, broadcast_keys=0).collect()} == want


def test_secrets_of_rows_with_one_id(spark):
    key = "Zq8Xv2Lm9Rt4Wb7Yc3Hd"
    rows = [(None, "password=abcdefgh1", "a"), (7, f"my {key}", "a"), (7, "token=zzzzzzzzz9", "b"), (7, None, "a")]
    got = {r["spans"] for r in secret_scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got == {"assign:0:18", "owned:3:23", "assign:0:16", ""}


def test_two_hundred_languages_and_texts_without_letters(spark):
    rng = np.random.default_rng(0)
    rows = []
    for n in range(200):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(40)]
        rows += [(1000 * n + i, " ".join(rng.permutation(words)), f"l{n:03}") for i in range(3)]
    odd = [(-1, "\U0001f600\U0001f680"), (-2, "١٢٣ ،"), (-3, "・ ！"), (-4, "123 ..."), (-5, None), (-6, "̈")]
    docs = spark.createDataFrame(rows + [(i, t, None) for i, t in odd], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in language_spans(docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["spans"] == [] for i, _ in odd)
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows]) >= 0.99


def test_step_groups_are_even(documents):
    rng = np.random.default_rng(1)
    steps = Steps(65_536, 0)
    dealt = steps.add([(1024, [(0, 0, n), (1, 0, 1024 - n)]) for n in rng.integers(1, 1024, 1024).tolist()])
    costs, sizes = {}, {}
    for group, _, pieces in dealt + steps.end():
        costs[group] = costs.get(group, 0) + cost(pieces)
        sizes[group] = sizes.get(group, 0) + 1
    assert set(sizes.values()) == {64} and max(costs.values()) <= 1.02 * min(costs.values())
    rows = packed(documents).toPandas()
    assert rows.groupby(["step_group", "window"]).length.sum().max() <= 65_536


def test_kept_by_exact_quantiles(documents):
    """Small groups: the sketches are exact, so the verdicts are those of sorted values."""
    rows = quality_rules(documents, least_rows=20).collect()
    by = {r["doc_id"]: r for r in documents.select("doc_id", "lang", "source").collect()}
    fine = [r for r in rows if not r["base_failed"]]

    def quartiles(name, part, test):
        some = [r for r in fine if test(by[r["doc_id"]])]
        values = sorted(r[name] for r in some if not part or r[name] > 0)
        if len(some) < 20 or len(values) < (5 if part else 20):
            return None
        return [values[int(np.ceil(q * len(values))) - 1] for q in (0.25, 0.75)]

    for r in rows:
        d, outside = by[r["doc_id"]], 0
        for name, low, part in METRICS:
            q = quartiles(name, part, lambda x: (x["lang"], x["source"]) == (d["lang"], d["source"])) or quartiles(name, part, lambda x: x["lang"] == d["lang"])  # noqa: B023
            if q is None:
                values = sorted(x[name] for x in fine if not part or x[name] > 0) or [0.0]
                q = [values[int(np.ceil(p * len(values))) - 1] for p in (0.25, 0.75)]
            reach = 3 * max(q[1] - q[0], TIE)
            outside += r[name] > q[1] + reach or (low and r[name] < q[0] - reach)
        assert r["n_outside"] == outside and r["kept"] == (not r["base_failed"] and outside == 0), r["doc_id"]


def test_near_classes_of_rows_without_an_id(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(words[30:])]
    docs = spark.createDataFrame([(None, texts[1]), (5, texts[0]), (9, texts[2])], "doc_id bigint, text string")
    assert near_classes(dict(enumerate(texts)))[0] == {0: 0, 1: 0, 2: 2}
    assert sorted(r["doc_id"] for r in keep_one_of_each(docs).collect()) == [5, 9]

"""Collocations against a count of every phrase."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_paths import connect_rows

from tidefold.llm import collocations as c
from tidefold.llm import common, queries


def counted(rows, least, longest, top, share):
    """rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in some.items():
            inside = lambda q, p=p: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(inside(q) and 100 * b >= share * a for q, b in some.items()):
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, t.decode(), -a, l, r, n[lang], -s) for i, (s, a, t, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def corpus(seed, size=60):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "The", "x", "new", "york", "city", "été", "日本", "a-b", "rare%d"]
    weights = np.array([9, 7, 2, 5, 4, 4, 2, 1, 1, 1, 1], float)
    rows = []
    for _ in range(size):
        picked = rng.choice(len(words), rng.integers(0, 60), p=weights / weights.sum())
        text = "".join((words[i] % rng.integers(50) if "%" in words[i] else words[i]) + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ; "], p=[0.7, 0.05, 0.05, 0.08, 0.04, 0.04, 0.04])) for i in picked)
        rows.append((str(rng.choice(["en", "fr"])) if rng.random() > 0.1 else [None, "und"][int(rng.integers(2))], text))
    return rows + [("en", None), ("fr", ""), (None, "...;;\n"), ("fr", "the of " * 200), ("en", " ".join(["new york city"] * 40))]


@pytest.mark.parametrize("seed,least,longest,top,share", [(1, 4, 4, 2000, 80), (2, 3, 3, 7, 50), (3, 2, 5, 40, 100), (4, 5, 2, 3, 80)])
def test_against_a_count_of_all(spark, seed, least, longest, top, share, monkeypatch):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, x, "k", 3) for i, (x, t) in enumerate(rows)], "doc_id int, text string, lang string, key string, phrase int").repartition(3)
    want = counted(rows, least, longest, top, share)
    get = lambda **o: sorted(tuple(r) for r in c.collocations(df, least=least, longest=longest, top=top, share=share, **o).collect())
    assert get() == want and len(want) > 3
    # Frequent pivots in parts, and words and counts that meet by a shuffle.
    monkeypatch.setattr(common, "HOT", 20)
    assert get() == want
    assert get(most_words=0) == want


def test_rows_of_all_kinds(spark, awkward, nothing):
    rows = [(r["lang"], r["text"]) for r in awkward.collect()]
    for options in ({}, {"most_words": 0}):
        assert sorted(tuple(r) for r in c.collocations(awkward, least=2, **options).collect()) == counted(rows, 2, 4, 2000, 80)
        assert c.collocations(nothing, **options).count() == 0


def test_a_text_in_many_pieces_and_none(spark):
    rows = [("en", "alpha beta gamma " * 30_000), ("en", "alpha beta. " * 10_000), ("de", "x" * 500_000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in c.collocations(df).collect()) == counted(rows, 30, 4, 2000, 80)


def test_rows_whose_hashes_are_equal(monkeypatch):
    columns = [np.array([5, 7, 5, 9, 7], np.int64), np.array([1, 2, 1, 1, 3], np.int64)]
    rows = list(zip(*[x.tolist() for x in columns], strict=True))
    for equal in (False, True):
        if equal:
            monkeypatch.setattr(c, "mixed", lambda h: h * np.uint64(0))
        first, back = c._grouped(columns)
        assert sorted(rows[i] for i in first) == sorted(set(rows)) and [rows[first[k]] for k in back] == rows


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_mining_a_few_fragments_at_a_time(monkeypatch, size):
    """Pivots that don't fit give parts, whose sums are those of all at once."""
    monkeypatch.setattr(c, "MINED", size)
    rng = np.random.default_rng(6)
    # Pivots are told from other words by their numbers, so a phrase shows its shape.
    rows = np.stack([np.zeros(300, np.int64), 10 + np.sort(rng.integers(0, 6, 300)), np.zeros(300, np.int64), *rng.integers(-1, 3, (6, 300)), rng.integers(1, 4, 300)])
    for d in (1, 2, 4, 5):
        rows[3 + d] = np.where(rows[2 + d] == c.NONE, c.NONE, rows[3 + d])
    want = Counter()
    for r in rows.T.tolist():
        left, right = [x for x in r[3:6] if x >= 0], [x for x in r[6:9] if x >= 0]
        for i in range(len(left) + 1):
            for j in range(len(right) + 1):
                if 1 <= i + j <= 3:
                    want[(*left[:i][::-1], r[1], *right[:j])] += r[-1]
    miner, got = c.Miner(5, 4), Counter()
    for at in range(0, 300, 7):
        for made in (miner.add(rows[:, at : at + 7]), miner.end() if at + 7 >= 300 else ()):
            for _, words, total in made:
                for k, n in enumerate(total.tolist()):
                    got[tuple(int(w[k]) for w in words)] += n
    frequent = {k: n for k, n in want.items() if n >= 5}
    assert len(frequent) > 20 and {k: got[k] for k in frequent} == frequent and all(n <= want[k] for k, n in got.items())
    assert size < 1000 or got == frequent


def test_query_equals_sql(spark, tables):
    connect_rows(spark, tables, queries.op13_collocations, queries.SQL["op13_collocations"])

import random

import pytest
from brute import near_classes, normalised
from hashlib import sha256

from tidefold.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from tidefold.llm.ngram_join import keep_one_of_each, near_duplicates


def near_fixture(seed=1, group=60):
    """Clean texts, one large group of edited copies, pairs at many distances, exact copies and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    docs, n = {}, 0

    def put(text):
        nonlocal n
        docs[n] = text
        n += 1

    base = [word() for _ in range(120)]
    for _ in range(group):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        put(" ".join(w))
    for edits in range(12):
        a = [word() for _ in range(80)]
        b = list(a)
        for _ in range(edits):
            b[rng.randrange(80)] = word()
        put(" ".join(a))
        put("\n".join(b))
    for _ in range(40):
        put(" ".join(word() for _ in range(rng.randint(1, 60))))
    for i in (0, 3, 70, 71):
        put(docs[i].replace(" ", "  "))
    for t in ("a b", "a b", "", None, "a  b c"):
        put(t)
    return docs


@pytest.mark.parametrize(("block", "small"), [(512, 24), (16, 4), (8, 2)])
def test_near_duplicates_equal_brute_force(spark, block, small):
    docs = near_fixture()
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    classes, links = near_classes(docs)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(df, block=block, small_bucket=small).collect()}
    assert got == {i: (classes[i], links[i]) for i in docs}


def test_near_duplicates_of_the_table(spark, documents):
    docs = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    classes, links = near_classes(docs)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(documents).collect()}
    assert got == {i: (classes[i], links[i]) for i in docs}
    kept = {r["doc_id"] for r in keep_one_of_each(documents).collect()}
    assert kept == {i for i in docs if classes[i] == i}


def test_near_duplicates_awkward(awkward, nothing):
    got = near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got}
    assert by[1] == (1, 0) and by[2] == (2, 0) and by[3] == (3, 0) and by[None] == (None, 0)
    assert by[4][0] == by[5][0] == by[6][0] == 4
    assert near_duplicates(nothing).count() == 0
    assert keep_one_of_each(awkward).columns == awkward.columns


def brute_exact(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(normalised(t), []).append(i)
    return groups


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_exact_duplicates_equal_brute_force(documents, broadcast):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    groups = brute_exact(docs)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_duplicates(documents, broadcast_keys=broadcast, digest=True).collect()}
    want = {i: (min(groups[normalised(t)]), len(groups[normalised(t)]), i == min(groups[normalised(t)]), sha256(normalised(t).encode()).hexdigest()) for i, t in docs}
    assert got == want


def test_exact_duplicates_awkward(awkward, nothing):
    got = exact_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got}
    assert by[2] == (1, 2, False) and by[3] == (3, 1, True) and by[4] == (4, 4, True) and by[6] == (4, 4, False) and by[None] == (None, 1, True)
    assert exact_duplicates(nothing).count() == 0
    kept = drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 7, 8, 9, 10]

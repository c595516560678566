import zlib

import numpy as np
import pytest
from brute import normalised
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tidefold.llm.common import stored
from tidefold.llm.packing import Tokens, pack, packed


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, texts, whole):
    """Pieces cover each text once in order, sequences are gapless and powers of two, and the ids are the tokenizer's."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in texts.items():
        ids = np.array(whole(text), np.uint32)
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and zlib.crc32(ids[at : at + r["length"]]) == r["ids_crc32"]
            if "ids" in r:
                assert list(r["ids"]) == ids[at : at + r["length"]].tolist()
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0 and {r["window"] for r in pieces} == {at}


def test_packing_of_the_table(documents, whole):
    check(packed(documents).collect(), {r["doc_id"]: r["text"] for r in documents.collect()}, whole)


def test_packing_with_ids(documents, whole):
    some = documents.where("doc_id < 40")
    check([r.asDict() for r in packed(some, with_ids=True).collect()], {r["doc_id"]: r["text"] for r in some.collect()}, whole)


def test_packing_awkward(awkward, nothing, whole):
    once = awkward.where("doc_id is not null and doc_id <> 6")
    check(packed(once).collect(), {r["doc_id"]: r["text"] for r in once.collect()}, whole)
    assert packed(awkward).where("doc_id is null").count() >= 1 and packed(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=1, max_size=60))
def test_pack_covers_and_fills(lengths):
    pieces = pack(np.array(lengths))
    filled, covered = {}, {}
    for row, start, n, sequence, offset, window in pieces:
        covered.setdefault(row, []).append((start, n))
        filled.setdefault((sequence, window), []).append((offset, n))
    assert {r: sum(n for _, n in p) for r, p in covered.items()} == dict(enumerate(lengths))
    for (_, window), parts in filled.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == window and window & (window - 1) == 0
    assert len({s for s, _ in filled}) == len(filled)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.from_regex(r"[A-Za-z.,' \néİ!|<>0-9-]{0,60}", fullmatch=True))
def test_tokens_equal_the_tokenizer(text):
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    text = text.encode("utf-8", "ignore").decode()
    (_, ids, edges), *_ = Tokens(path).of(pa.array([text, "x"]))
    assert ids[edges[0] : edges[1]].tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2]


def test_steps_are_balanced(documents):
    rows = packed(documents).toPandas()
    sizes = rows.groupby(["step_group", "window"]).length.sum()
    assert (sizes <= 65_536).all() and rows.groupby("step_group").window.nunique().eq(1).all()


def test_pipeline(spark, tables, labels):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, tables), "test")
        stages[name] = now.cache()
    for name in list(stages)[:-1]:
        assert stages[name].columns == docs.columns
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in stages.items()}
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    good = {r["doc_id"] for r in labels.where("toxic = 0 and quality = 1").collect()}
    assert len(toxic & set(ids["toxicity"])) <= 0.3 * len(toxic) and len(good & set(ids["toxicity"])) >= 0.97 * len(good)
    texts = {r["doc_id"]: normalised(r["text"]) for r in docs.collect()}
    kept = [texts[i] for i in ids["exact dedup"]]
    assert len(kept) == len(set(kept)) and set(kept) == {texts[i] for i in ids["toxicity"]}
    assert set(ids["n-gram Jaccard join"]) <= set(ids["exact dedup"]) and set(ids["mixing"]) <= set(ids["n-gram Jaccard join"])
    assert set(ids["packing"]) == set(ids["mixing"])
    assert corpus_pipeline.run(spark, tables).count() == stages["packing"].count()


def test_pipeline_stages_awkward(spark, awkward, nothing, tables):
    for docs in (awkward, nothing):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = stored(stage(spark, now, tables), "awkward")
            if name != "packing":
                assert now.columns == docs.columns
        assert (now.count() == 0) == (docs is nothing)

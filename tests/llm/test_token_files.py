"""Token files against the tokenizer, and blocks of planes there and back."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidefold.llm import queries, token_files
from tidefold.llm.token_files import decoded, encoded, ids_between, read_token_files, write_token_files


@pytest.fixture(scope="module")
def whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def expected(rows, whole):
    """rows: (doc_id, text), ids all different. (doc_id, start, n_tokens, ids_crc32) and all ids."""
    out, every = [], []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(text)
        out.append((i, len(every), len(ids), zlib.crc32(np.array(ids, "<u4"))))
        every += ids
    return out, every


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70_000), max_size=300), st.sampled_from(["byte", "bit"]))
def test_a_block_comes_back(ids, planes):
    data = encoded(np.array(ids, np.uint32), planes)
    assert decoded(data).tolist() == ids


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_damage_is_seen(planes):
    data = bytearray(encoded(np.arange(5000, dtype=np.uint32), planes))
    for at in (0, 9, 11, len(data) - 3):
        bad = data.copy()
        bad[at] ^= 1
        with pytest.raises(Exception):  # noqa: B017  zstandard has errors of its own
            decoded(bytes(bad))


def test_query_over_the_table(spark, tables, documents, whole):
    want, _ = expected([tuple(r) for r in documents.select("doc_id", "text").collect()], whole)
    assert [tuple(r) for r in queries.op11_token_planes(spark, tables).orderBy("start").collect()] == want


@pytest.mark.parametrize("planes,block", [("byte", 1000), ("bit", 64), ("bit", 65_536)])
def test_blocks_cut_documents_anywhere(spark, tmp_path, documents, whole, planes, block):
    some = documents.where("doc_id < 40")
    want, every = expected([tuple(r) for r in some.select("doc_id", "text").collect()], whole)
    path = str(tmp_path / "files")
    write_token_files(some, path, planes=planes, block=block)
    rows = read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    assert [tuple(r)[:4] for r in rows] == want and [i for r in rows for i in r["ids"]] == every
    middle = min(block, len(every) // 2)
    for low, high in ((0, 1), (middle - 1, 3 * middle + 5), (len(every) - 7, len(every) + 100)):
        found = sorted((r["start"], r["ids"]) for r in ids_between(spark, path, low, high).collect())
        assert [i for _, ids in found for i in ids] == every[low:high] and found[0][0] == low
    index = spark.read.parquet(f"{path}/index").orderBy("start").collect()
    assert index[0]["start"] == 0 and all(a["start"] + a["n_ids"] == b["start"] for a, b in zip(index, index[1:], strict=False))
    assert sum(r["n_docs"] for r in index) == len(want)


def test_rows_of_all_kinds(spark, tmp_path, awkward, nothing, whole):
    write_token_files(awkward, str(tmp_path / "a"), block=500)
    rows = read_token_files(spark, str(tmp_path / "a")).orderBy("start").collect()
    one = lambda i, text: (i or 0, len(whole(text)), zlib.crc32(np.array(whole(text), "<u4")))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted(one(r["doc_id"], r["text"]) for r in awkward.collect())
    assert [r["doc_id"] or 0 for r in rows] == sorted(r["doc_id"] or 0 for r in rows) and rows[0]["doc_id"] is None
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    write_token_files(nothing, str(tmp_path / "n"))
    assert read_token_files(spark, str(tmp_path / "n")).count() == ids_between(spark, str(tmp_path / "n"), 0, 9).count() == 0


def test_one_id_in_many_rows(spark, tmp_path, whole):
    texts = [f"text number {i} of one id" for i in range(400)] + [None] * 30
    df = spark.createDataFrame([(7, t) for t in texts], "doc_id bigint, text string").repartition(3)
    write_token_files(df, str(tmp_path / "o"), block=100)
    rows = read_token_files(spark, str(tmp_path / "o")).collect()
    assert sorted(r["ids_crc32"] for r in rows) == sorted(zlib.crc32(np.array(whole(t), "<u4")) for t in texts)
    with pytest.raises(ValueError):
        write_token_files(df, str(tmp_path / "p"), planes="nibble")
    assert token_files.Blocks(4).add([], np.empty(0, np.uint32), np.array([0])) is not None

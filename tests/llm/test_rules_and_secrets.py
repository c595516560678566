from brute import base_digest, base_spans, rule_statistics
from conftest_paths import connect_rows
from tidefold.llm import queries
from tidefold.llm.quality_rules import quality_rules
from tidefold.llm.secret_scan import secret_scan


def check_rules(df):
    texts = {(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}
    got = {(r["doc_id"]): r for r in quality_rules(df).collect()}
    for i, t in texts:
        n, chars, symbols, dup, repeat = rule_statistics(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat), i
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and (not r["kept"] or not r["base_failed"])
    return got


def test_rules_of_the_table(documents, labels):
    got = check_rules(documents)
    good = [r["doc_id"] for r in labels.where("quality = 1").collect() if not got[r["doc_id"]]["base_failed"]]
    bad = [r["doc_id"] for r in labels.where("quality = 0").collect()]
    assert sum(got[i]["kept"] for i in good) >= 0.97 * len(good)
    assert sum(got[i]["kept"] for i in bad) <= 0.3 * len(bad)


def test_rules_awkward(awkward, nothing):
    assert len(check_rules(awkward)) == 11 and quality_rules(awkward).count() == awkward.count()
    assert quality_rules(nothing).count() == 0


def test_cutoffs_follow_the_group(spark):
    """What is usual in one source is outside in another."""
    line = lambda i, marks: " ".join(f"w{i}x{j}" + ("#" if j < marks else "") for j in range(60))
    rows = [(i, line(i, 20 + i % 5), "en", "forum") for i in range(250)] + [(1000 + i, line(i, 0), "en", "news") for i in range(250)] + [(5000, line(7, 30), "en", "news")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(250)) and got[1000] and not got[5000]


def test_cutoffs_come_from_the_sketches(spark):
    """Short words, and repeats that only another source has, are outside though both lie far within the old fixed reach."""
    word = lambda k, j, n: f"{k}x{j}".ljust(n, "y")[:n]
    plain = lambda k, n: " ".join(word(k, j, n) for j in range(100))
    # A text that begins with times copies of one three-word window.
    again = lambda k, times: " ".join(["a11111111", "b22222222", "c33333333"] * times + [word(k, j, 9) for j in range(100 - 3 * times)])
    rows = [(i, plain(i, 9 + i % 2), "en", "forum") for i in range(200)] + [(1000 + i, again(i, 2 + i % 3), "en", "forum") for i in range(100)]
    rows += [(2000 + i, plain(i, 9 + i % 2), "en", "news") for i in range(200)] + [(3000 + i, again(i, 8 + i % 3), "en", "news") for i in range(100)]
    rows += [(9000, plain(7, 5), "en", "news"), (9001, plain(8, 14), "en", "news"), (9002, again(9, 11), "en", "forum"), (9003, again(9, 11), "en", "news")]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not any(r["base_failed"] for r in got.values()) and all(got[i]["kept"] for i in got if i < 9000)
    assert [got[i]["kept"] for i in (9000, 9001, 9002, 9003)] == [False, False, False, True]


def test_all_rows_may_fail_the_base_rules(spark):
    rows = quality_rules(spark.createDataFrame([(1, "too short", "en", "a"), (2, None, None, None)], "doc_id bigint, text string, lang string, source string")).collect()
    assert len(rows) == 2 and not any(r["kept"] for r in rows)


def check_secrets(df):
    got = {r["doc_id"]: r for r in secret_scan(df).collect()}
    for r in df.select("doc_id", "text").collect():
        spans, g = base_spans(r["text"]), got[r["doc_id"]]
        assert (g["n_assign"], g["n_access"], g["n_hex"]) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert g["base_sha256"] == base_digest(r["text"])
        kinds = ("assign", "access", "hex")
        assert [x for x in g["spans"].split(",") if x and not x.startswith("owned")] == [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]
    return got


def test_secrets_of_the_table(documents):
    check_secrets(documents)


def test_secrets_awkward(awkward, nothing):
    got = check_secrets(awkward)
    assert got[9]["n_assign"] == 1 and got[9]["n_access"] == 1 and got[9]["n_hex"] == 1
    assert secret_scan(awkward).count() == awkward.count() and secret_scan(nothing).count() == 0


def test_copied_examples_are_told_from_owned_ones(spark):
    key, example = "Zq8Xv2Lm9Rt4Wb7Yc3Hd", "Ex4mpleEx4mpleEx4mple"
    rows = [(i, f"use {example} é here", f"s{i}") for i in range(5)] + [(9, f"é my {key}", "s1"), (10, f"password={example}", "s2")]
    got = {r["doc_id"]: r for r in secret_scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got[9]["spans"] == "owned:5:25" and got[9]["n_owned"] == 1 and got[9]["n_live"] == 1
    assert all(got[i]["spans"] == "" and got[i]["n_copied"] == 1 for i in range(5))
    assert got[10]["spans"].startswith("assign:") and got[10]["n_copied"] == 1


def test_queries_equal_sql(spark, tables):
    for name in queries.SQL:
        connect_rows(spark, tables, queries.QUERIES[name], queries.SQL[name])

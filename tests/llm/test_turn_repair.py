"""Repair of conversations against a search over all edits, and over chunks of any size."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest_paths import connect_rows

from tidefold.llm import queries, turn_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, _conv string, audit int, _key string"
BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    """rows: (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def searched(rows):
    """(cost, audit, repaired rows) of the cheapest edits, of equal ones the ASCII-least: every sequence of edits up to the cost of deleting all."""
    kinds, best = faults(rows), (2 * len(rows) + 1, "", [])

    def go(i, cost, audit, made):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)):
                best = min(best, (cost, audit, made))
        else:
            role, text = rows[i]
            go(i + 1, cost + 2, audit + "D", made)
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 * (kinds[i] == "truncated")
                go(i + 1, cost + more, audit + "K", made + [(role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, cost + 1 + more, audit + "R", made + [(other, text)])
        for other in ("user", "assistant"):
            go(i, cost + 5, audit + "I", made + [(other, "")])

    go(0, 0, "", [])
    return best


def summary(turns, search=searched):
    """turns: (turn, role, text), nulls in role and text already one space."""
    rows = [(r, t) for _, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0))]
    kinds, numbers = faults(rows), [n for n, _, _ in turns if n is not None]
    cost, audit, made = search(rows)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def folded(rows):
    """The same by a table over places and states, for long conversations."""
    kinds, after = faults(rows), {"": (0, "", "")}
    moves = {"": "su", "s": "u", "u": "a", "a": "u"}
    better = lambda d, k, v: d.__setitem__(k, min(d.get(k, v), v))

    def inserted(states):
        out = dict(states)
        for k, (c, a, w) in states.items():
            to = "a" if k == "u" else "u"
            better(out, to, (c + 5, a + "I", w + to))
        return out

    for (role, _), kind in zip(rows, kinds):
        now = {}
        for k, (c, a, w) in inserted(after).items():
            better(now, k, (c + 2, a + "D", w + "-"))
            if kind not in ("blank", "duplicate"):
                more = 5 * (kind == "truncated")
                if role[:1] and role[:1] in moves[k]:
                    better(now, role[:1], (c + more, a + "K", w + role[:1]))
                to = "a" if k == "u" else "u"
                better(now, to, (c + 1 + more, a + "R", w + to))
        after = now
    cost, audit, _ = min(v for k, v in inserted(after).items() if k in ("", "a"))
    made, last, it = [], "", iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(it)
        if letter == "D":
            continue
        role = role if letter == "K" else "assistant" if last == "u" else "user"
        made.append((role, text))
        last = role[:1]
    return cost, audit, made


def random_turns(rng, n):
    roles, texts = ("user", "assistant", "system", None, "tool", "user", "assistant"), ("Yes.", "No!", "cut off", None, "", " \n", "Why? ", "a", "b.", "c.", "d.", "e.", "f")
    return [(int(rng.integers(0, n + 2)) if rng.random() > 0.1 else None, roles[rng.integers(7)], texts[rng.integers(13)]) for _ in range(n)]


def test_small_conversations_by_search(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = {c: [] for c in (None, *range(60))}
    for c in rows:
        # Places differ, so that the order is one.
        some = random_turns(rng, int(rng.integers(1, 6)))
        places = rng.permutation(8)[: len(some)].tolist()
        rows[c] = [(p if rng.random() > 0.2 or i else None, r, t) for i, (p, (_, r, t)) in enumerate(zip(places, some))]
    df = spark.createDataFrame([(c, *x, "x", 1, "k") for c, some in rows.items() for x in some], SCHEMA)
    want = {c: summary([(n, " " if r is None else r, " " if t is None else t) for n, r, t in some]) for c, some in rows.items()}
    for chunk, fan in ((256, 64), (1, 2)):
        monkeypatch.setattr(turn_repair, "CHUNK", chunk)
        monkeypatch.setattr(turn_repair, "FAN", fan)
        assert {r[0]: tuple(r[1:]) for r in turn_repair.repair(df).collect()} == want


def test_long_conversations_lie_in_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(turn_repair, "CHUNK", 16)
    monkeypatch.setattr(turn_repair, "FAN", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    roles = ("user", "assistant", "user", "assistant", "system")
    rows = {c: [(i, roles[rng.integers(5)] if rng.random() < 0.3 else roles[i % 2], "same text." if rng.random() < 0.2 else f"turn {i}" + "." * int(rng.random() < 0.8)) for i in range(n)] for c, n in ((1, 3000), (2, 40), (3, 1))}
    df = spark.createDataFrame([(c, *x) for c, some in rows.items() for x in some], "conv_id bigint, turn bigint, role string, text string").repartition(4)
    try:
        got = {r[0]: tuple(r[1:]) for r in turn_repair.repair(df).collect()}
        made = turn_repair.repaired_turns(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {c: summary(some, folded) for c, some in rows.items()}
    for c, some in rows.items():
        own = sorted((r["place"], r["role"], r["text"]) for r in made if r["conv_id"] == c)
        assert [p for p, _, _ in own] == list(range(len(own))) and [(r, t) for _, r, t in own] == folded([(r, t) for _, r, t in some])[2]


def test_rows_that_are_equal_and_frequent(spark, monkeypatch):
    from tidefold.llm import common

    df = spark.createDataFrame([(1, 5, "user", "Hello.")] * 50 + [(1, None, "user", "Hello.")] * 3 + [(2, 0, "assistant", None)], "conv_id bigint, turn bigint, role string, text string")
    want = {1: summary([(None, "user", "Hello.")] * 3 + [(5, "user", "Hello.")] * 50, folded), 2: summary([(0, "assistant", " ")])}
    for hot in (1, 10_000):
        monkeypatch.setattr(common, "HOT", hot)
        assert {r[0]: tuple(r[1:]) for r in turn_repair.repair(df).collect()} == want


def test_query_by_search_over_the_table(spark, tables):
    rows = {}
    for c, n, r, t in spark.read.parquet(f"{tables}/conversations.parquet").collect():
        rows.setdefault(c, [])
        r, t = " " if r is None else r, " " if t is None else t
        which = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        if which:
            rows[c] += [(n, "user" if which == 4 else r, "" if which == 1 else re.sub("[.!?]", "", t) if which == 2 else t)] * (2 if which == 3 else 1)
    want = {c: summary(some, searched if len(some) < 6 else folded) for c, some in rows.items()}
    assert {r[0]: tuple(r[1:]) for r in queries.op12_turn_repair(spark, tables).collect()} == want


def test_query_equals_sql(spark, tables):
    connect_rows(spark, tables, queries.op12_turn_repair, queries.SQL["op12_turn_repair"])


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair(empty).count() == turn_repair.repaired_turns(empty).count() == turn_repair.repair_damaged(empty).count() == 0


def test_a_conversation_without_rows_left_stays(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = turn_repair.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")).first()
    assert tuple(got) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("text", ["x" * 200_000 + ".", " " * 100_000])
def test_very_long_texts(spark, text):
    got = turn_repair.repair(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "Yes.")], "conv_id bigint, turn bigint, role string, text string")).first()
    assert tuple(got)[1:] == summary([(0, "user", text), (1, "assistant", "Yes.")])

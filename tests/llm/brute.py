"""Plain versions of the text operators, for small fixtures."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256

BLANK = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str, n: int = 5) -> set:
    w = WORD.findall(text or "")
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def near_classes(docs: dict[int, str], threshold: float = 0.8) -> tuple[dict[int, int], dict[int, int]]:
    sets = {i: shingles(t) for i, t in docs.items()}
    root, links = {i: i for i in docs}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: links[i] for i in ids}


ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(t) if len(m[0]) >= 32])


def base_digest(text: str | None) -> str:
    kinds = ("assign", "access", "hex")
    return sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base_spans(text)).encode()).hexdigest()


def normalised(text: str | None) -> str:
    return BLANK.sub(" ", text or "")


def rule_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] >= 2 for j in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")

"""Plain versions of the operators, for small inputs: loops over Python strings, sets and dicts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def substring(rows: list[tuple[int, str | None]], window: int = 35) -> list[tuple]:
    docs = [words(t) for _, t in rows]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for (doc_id, _), d in zip(rows, docs):
        gone = set()
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(d) if i not in gone)
        out.append((doc_id, len(d), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def component_of(nodes: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard(rows: list[tuple[int, str | None]]) -> list[tuple]:
    sets = {i: shingle_set(t) for i, t in rows}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    common = Counter()
    for found in at.values():
        for a in range(len(found)):
            for b in range(a + 1, len(found)):
                common[found[a], found[b]] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    comp = component_of([i for i, _ in rows], links)
    return sorted((i, len(sets[i]), comp[i]) for i in sets)

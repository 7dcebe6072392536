"""Plain versions of what the operators compute, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UP))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_duplicates(docs: list[tuple], percent: int = 75) -> dict:
    """doc_id: smallest doc_id reachable."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(sets, 2):
        s, t = sets[i], sets[j]
        both = len(s & t)
        if s and t and 100 * both >= percent * (len(s) + len(t) - both):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def repeated_windows(docs: list[tuple], size: int = 50) -> dict:
    """doc_id: starts of windows of that many words that another document has as well."""
    where = defaultdict(set)
    for i, t in docs:
        w = words(t)
        for j in range(len(w) - size + 1):
            where[tuple(w[j : j + size])].add((i, j))
    out = defaultdict(set)
    for places in where.values():
        if len({i for i, _ in places}) > 1:
            for i, j in places:
                out[i].add(j)
    return out


def secrets(text: str | None) -> list[str]:
    t = text or ""
    found = []
    for k, (kind, pattern, least, group, flags) in enumerate(
        [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 18, 0, 0), ("hex", r"[0-9a-f]+", 16, 0, 0)]
    ):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t, flags) if len(m[group]) >= least]
    return [x[2] for x in sorted(found)]

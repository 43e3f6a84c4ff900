"""Brute-force versions of the training-data operators, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, lower: bool = False) -> list[str]:
    return SPACE.findall((text or "").translate(LOWER) if lower else text or "")


def shingle_set(text: str | None, k: int, lower: bool = True) -> set[tuple[str, ...]]:
    w = words(text, lower)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def near_duplicates(docs: list[tuple[int, str | None]], k: int) -> dict[int, tuple[int, int]]:
    """doc_id: (set size, component), by comparing every pair that shares a shingle."""
    sets = {i: shingle_set(t, k) for i, t in docs}
    by_shingle, parent = defaultdict(list), {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        shared: dict[int, int] = defaultdict(int)
        for x in s:
            for j in by_shingle[x]:
                shared[j] += 1
            by_shingle[x].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}

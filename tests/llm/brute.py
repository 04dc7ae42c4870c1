"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None, k: int = 5) -> set:
    found = SPACE.findall(lower(text))
    if len(found) < k:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)}


def near_duplicates(rows: list[tuple[int, str | None]], k: int = 5, percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component), for distinct doc_ids, by comparing all documents that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for held in holders.values():
        for n, i in enumerate(held):
            for j in held[:n]:
                if (i, j) in seen:
                    continue
                seen.add((i, j))
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((top(i), top(j)))
                    parent[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def benchmark_hits(text: str | None, items: list[tuple[object, str | None]], span: int = 13) -> tuple:
    """n_words, n_hit, sorted item ids."""
    found = ITEM.findall(lower(text))
    hit, ids = set(), set()
    for item_id, item in items:
        wanted = ITEM.findall(lower(item))
        size = min(span, len(wanted))
        if not size or item_id is None:
            continue
        windows = {tuple(wanted[i : i + size]) for i in range(len(wanted) - size + 1)}
        for i in range(len(found) - size + 1):
            if tuple(found[i : i + size]) in windows:
                hit.update(range(i, i + size))
                ids.add(str(item_id))
    return len(found), len(hit), sorted(ids)


PATTERNS = [
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]


def base_secrets(text: str | None) -> list[str]:
    spans = []
    for order, (kind, pattern, group, least) in enumerate(PATTERNS):
        flags = re.ASCII | (re.IGNORECASE if kind == "assign" else 0)
        spans += [
            (m.start(), order, f"{kind}:{m.start()}:{m.end()}")
            for m in re.finditer(pattern, text or "", flags)
            if len(m[group]) >= least
        ]
    return [s for _, _, s in sorted(spans)]


def base_scores(rows: list[tuple[int, str | None, bool]]) -> tuple[int, dict[int, tuple[int, int, float]]]:
    """Training tokens, and per doc_id n_tokens, n_known and the base score."""
    import math
    from collections import Counter

    tokens = {i: [*SPACE.findall(lower(t)), None] for i, t, _ in rows}
    counts = Counter(w for i, _, held in rows if not held for w in tokens[i])
    total, distinct = sum(counts.values()), len(counts)
    scored = {
        i: (
            len(ws),
            sum(counts[w] > 0 for w in ws),
            sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws),
        )
        for i, ws in tokens.items()
    }
    return total, scored

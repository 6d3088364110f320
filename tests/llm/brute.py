"""Plain single-process versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re

SPACE = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base secrets."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def window_entropy(text: str, window: int) -> float:
    best = 0.0
    for i in range(len(text) - window + 1):
        part = text[i : i + window]
        best = max(best, -sum(part.count(c) / window * math.log2(part.count(c) / window) for c in set(part)))
    return best


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    w = words(text)
    seen: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def shingle_set(text: str | None) -> set[tuple[str, ...]]:
    w = words(lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def jaccard_components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), comparing all pairs that share a shingle."""
    sets = {k: shingle_set(t) for k, t in docs}
    root = {k: k for k in sets}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    at: dict[tuple[str, ...], list[int]] = {}
    for k, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(k)
    shared: dict[tuple[int, int], int] = {}
    for ks in at.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def components_of_documents(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    """(doc_id, n_shingles, component_id) of every row, where rows that share a doc_id are one document."""
    found = jaccard_components([(i, t) for i, (_, t) in enumerate(docs)])
    root: dict[tuple[str, int], tuple[str, int]] = {}

    def find(a: tuple[str, int]) -> tuple[str, int]:
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for i, (n, first) in found.items():
        if n:
            root[find(("row", i))] = find(("row", first))
            root[find(("row", i))] = find(("doc", docs[i][0]))
    least: dict[tuple[str, int], int] = {}
    for k, _ in docs:
        at = find(("doc", k))
        least[at] = min(least.get(at, k), k)
    return sorted((k, found[i][0], least[find(("doc", k))] if found[i][0] else k) for i, (k, _) in enumerate(docs))


def substring_dedup(docs: list[tuple[int | None, str | None]], window: int = 50) -> list[tuple[int | None, int, int, str]]:
    """(doc_id, n_words, n_removed, digest of the kept words) of every row; a null id owns and loses nothing."""
    first: dict[tuple[str, ...], int] = {}
    for k, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1 if k is not None else 0):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, k), k)
    out = []
    for k, text in docs:
        w = words(text)
        lost = {i + j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < k for j in range(window)} if k is not None else set()
        out.append((k, len(w), len(lost), sha(" ".join(x for i, x in enumerate(w) if i not in lost))))
    return sorted(out, key=str)

"""Similarity of one pair of strings, for measures whose rules do not fit arrays."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np

from glyphweave.kernels import batch

jaro_winkler = batch.over_pairs(batch.jaro_winkler)
levenshtein = batch.over_pairs(batch.levenshtein)
osa = batch.over_pairs(batch.osa)
lcs_length = batch.over_pairs(batch.lcs_length)
needleman_wunsch = batch.over_pairs(batch.needleman_wunsch)
smith_waterman = batch.over_pairs(batch.smith_waterman)
common_prefix = batch.over_pairs(batch.common_prefix)
editex_capitals = batch.over_pairs(batch.editex)


def editex(x: list[str], y: list[str], as_bytes: bool) -> np.ndarray:
    return editex_capitals([t.upper() for t in x], [t.upper() for t in y], as_bytes)


def units(text: str, as_bytes: bool) -> bytes | str:
    return text.encode() if as_bytes else text


def lengths(x: list[str], as_bytes: bool) -> np.ndarray:
    return np.array([len(units(t, as_bytes)) for t in x], float)


def as_similarity(distance: np.ndarray, x: list[str], y: list[str], as_bytes: bool, scale: float = 1) -> np.ndarray:
    """1 - distance / longer length, and 1 for two empty texts."""
    longest = np.maximum(lengths(x, as_bytes), lengths(y, as_bytes))
    return np.where(longest == 0, 1.0, np.maximum(0, 1 - distance / np.maximum(scale * longest, 1)))


def damerau(a: str, b: str, as_bytes: bool) -> float:
    """Edits with unrestricted transpositions."""
    a, b = units(a, as_bytes), units(b, as_bytes)
    big, last = len(a) + len(b), {}
    d = np.full((len(a) + 2, len(b) + 2), big, np.int64).tolist()
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        found = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), found
            same = a[i - 1] == b[j - 1]
            if same:
                found = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return float(d[len(a) + 1][len(b) + 1])


def damerau_all(x: list[str], y: list[str], as_bytes: bool) -> np.ndarray:
    return np.array([damerau(a, b, as_bytes) for a, b in zip(x, y, strict=True)])


def hamming(x: list[str], y: list[str], as_bytes: bool) -> list[float]:
    return [float(sum(p != q for p, q in zip(a, b, strict=True))) if len(a) == len(b) else float("inf") for a, b in ((units(a, as_bytes), units(b, as_bytes)) for a, b in zip(x, y, strict=True))]


def longest_common(a: str, b: str, as_bytes: bool) -> str:
    """Longest common run; the first in a, then in b."""
    p, q = units(a, as_bytes), units(b, as_bytes)
    m = SequenceMatcher(None, p, q, autojunk=False).find_longest_match(0, len(p), 0, len(q))
    run = p[m.a : m.a + m.size]
    return run.decode("utf-8", "replace") if as_bytes else run


def gestalt(x: list[str], y: list[str], as_bytes: bool) -> list[float]:
    return [SequenceMatcher(None, units(a, as_bytes), units(b, as_bytes), autojunk=False).ratio() for a, b in zip(x, y, strict=True)]


def bag(x: list[str], y: list[str], as_bytes: bool) -> np.ndarray:
    out = []
    for a, b in zip(x, y, strict=True):
        p, q = Counter(units(a, as_bytes)), Counter(units(b, as_bytes))
        out.append(max((p - q).total(), (q - p).total()))
    return np.array(out, float)


def grams(text: str, q: int, as_bytes: bool) -> list:
    t = units(text, as_bytes)
    return [t[i : i + q] for i in range(len(t) - q + 1)]


def gram_measure(x: list[str], y: list[str], measure: str, q: int, as_bytes: bool, alpha: float = 0.5, beta: float = 0.5) -> list[float]:
    """Measures of sets (or, cosine, counts) of runs of q characters; equal texts have 1."""
    out = []
    for a, b in zip(x, y, strict=True):
        if a == b:
            out.append(1.0)
            continue
        if measure == "cosine":
            p, r = Counter(grams(a, q, as_bytes)), Counter(grams(b, q, as_bytes))
            dot, size = sum(n * r[g] for g, n in p.items()), sum(n * n for n in p.values()) * sum(n * n for n in r.values())
            out.append(dot / size**0.5 if size else 0.0)
            continue
        p, r = set(grams(a, q, as_bytes)), set(grams(b, q, as_bytes))
        both = len(p & r)
        over = {
            "jaccard": len(p | r), "dice": (len(p) + len(r)) / 2, "overlap": min(len(p), len(r)), "tversky": both + alpha * (len(p) - both) + beta * (len(r) - both),
        }[measure]
        out.append(both / over if over else 0.0)
    return out


def edit_ops(a: str, b: str, blocks: bool, as_bytes: bool) -> list[dict]:
    """The edits that make b of a, as single steps or as blocks, with places from 1; common ends are left alone, and of equal ways deletions come as late as they can."""
    p, q = units(a, as_bytes), units(b, as_bytes)
    low = 0
    while low < min(len(p), len(q)) and p[low] == q[low]:
        low += 1
    high = 0
    while high < min(len(p), len(q)) - low and p[len(p) - 1 - high] == q[len(q) - 1 - high]:
        high += 1
    s, t = p[low : len(p) - high], q[low : len(q) - high]
    d = [list(range(len(t) + 1))]
    for i in range(len(s)):
        row = [i + 1]
        for j in range(len(t)):
            row.append(min(d[i][j] + (s[i] != t[j]), d[i][j + 1] + 1, row[j] + 1))
        d.append(row)
    i, j, steps = len(s), len(t), []
    while i or j:
        if i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            steps.append(("delete", i, j))
        elif j and d[i][j] == d[i][j - 1] + 1:
            j -= 1
            steps.append(("insert", i, j))
        else:
            i, j = i - 1, j - 1
            if s[i] != t[j]:
                steps.append(("replace", i, j))
    steps = [(k, low + i, low + j) for k, i, j in reversed(steps)]
    if not blocks:
        return [{"type": k, "a_start": i + 1, "a_end": i + 1, "b_start": j + 1, "b_end": j + 1} for k, i, j in steps]
    out, at_a, at_b = [], 0, 0

    def add(kind: str, i: int, j: int) -> None:
        nonlocal at_a, at_b
        if i > at_a or j > at_b:
            out.append({"type": kind, "a_start": at_a + 1, "a_end": i, "b_start": at_b + 1, "b_end": j})
            at_a, at_b = i, j

    k = 0
    while k < len(steps):
        kind, i, j = steps[k]
        add("equal", i, j)
        n = 1
        move_a, move_b = kind != "insert", kind != "delete"
        while k + n < len(steps) and steps[k + n] == (kind, i + n * move_a, j + n * move_b):
            n += 1
        add(kind, i + n * move_a, j + n * move_b)
        k += n
    add("equal", len(p), len(q))
    return out


_STRIP = "['’-]"


def _token_alignment(s: list[str], t: list[str], score: dict, penalty: float | None) -> float:
    cells = sorted(((-score[a, b], i, j) for i, a in enumerate(s) for j, b in enumerate(t)))
    rows, columns, total, n = set(), set(), 0.0, 0
    for v, i, j in cells:
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            total, n = total - v, n + 1
    if penalty is None:
        return total / max(len(s), len(t))
    return max(0.0, total / n - penalty * abs(len(s) - len(t)))


def jaro_winkler_tokens(x: list[str], y: list[str], p: float, fold: bool, strip: str | None, penalty: float | None, contractions: bool) -> list[float]:
    """Best of a greedy alignment of words and of the words run together; contractions also try joined and rotated words."""
    clean = lambda v: (re.sub(strip, "", v) if strip else v).translate(_UPPER if fold else {})
    words = [(a.split(), b.split()) for a, b in zip(map(clean, x), map(clean, y), strict=True)]

    def others(s: list[str], t: list[str]) -> list[tuple[str, str]]:
        """What is compared besides single words: all run together, two joined with each other word, rotations of a lone word."""
        found = [("".join(s), "".join(t))]
        if contractions:
            found += [(left[i] + left[j], v) for left, right in ((s, t), (t, s)) for i in range(len(left)) for j in range(i + 1, len(left)) for v in right]
            if len(s) == len(t) == 1:
                found += [(s[0][k:] + s[0][:k], t[0]) for k in range(1, len(s[0]))]
        return found

    beside = [others(s, t) if s and t else [] for s, t in words]
    different = sorted({(u, v) for s, t in words for u in s for v in t}.union(*beside))
    score = dict(zip(different, jaro_winkler([u for u, _ in different], [v for _, v in different], True, p).tolist(), strict=True)) if different else {}
    return [max(_token_alignment(s, t, score, penalty), *(score[c] for c in more)) if s and t else float(not s and not t) for (s, t), more in zip(words, beside, strict=True)]


_UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def monge_elkan(x: list[str], y: list[str], inner: str, p: float, symmetric: bool, as_bytes: bool) -> list[float]:
    """Mean over the words of a of their best similarity with a word of b; both ways if symmetric."""
    measure = {
        "jaro_winkler": lambda s, t: jaro_winkler(s, t, as_bytes, p),
        "levenshtein": lambda s, t: as_similarity(levenshtein(s, t, as_bytes), s, t, as_bytes),
        "osa": lambda s, t: as_similarity(osa(s, t, as_bytes), s, t, as_bytes),
        "damerau_levenshtein": lambda s, t: as_similarity(damerau_all(s, t, as_bytes), s, t, as_bytes),
    }[inner]
    words = [(a.split(), b.split()) for a, b in zip(x, y, strict=True)]
    different = sorted({(u, v) for s, t in words for u in s for v in t})
    score = dict(zip(different, measure([u for u, _ in different], [v for _, v in different]).tolist(), strict=True)) if different else {}
    out = []
    for s, t in words:
        if not s or not t:
            out.append(float(not s and not t))
            continue
        there = sum(max(score[u, v] for v in t) for u in s) / len(s)
        back = sum(max(score[u, v] for u in s) for v in t) / len(t) if symmetric else there
        out.append((there + back) / 2)
    return out

"""Scores from 0 to 100 for strings that share parts or words."""

from __future__ import annotations

from collections.abc import Callable


def _masks(s: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(s):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _lcs(masks: dict[str, int], n: int, t: str) -> int:
    """Length of the longest common subsequence: a bit for each character of the first string."""
    full = (1 << n) - 1
    v = full
    for c in t:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * _lcs(_masks(a), len(a), b) / (len(a) + len(b)) if a or b else 100.0


def _best_window(a: str, b: str) -> tuple[float, int, int]:
    """The part of b, of at most the length of a, that is most like a; a is not longer than b."""
    masks, n, best = _masks(a), len(a), (0.0, 0, len(a))

    def consider(start: int, end: int) -> bool:
        nonlocal best
        score = 200.0 * _lcs(masks, n, b[start:end]) / (n + end - start)
        if score > best[0]:
            best = (score, start, end)
        return score == 100.0

    ends = [(0, i) for i in range(1, n) if b[i - 1] in masks]
    whole = [(i, i + n) for i in range(len(b) - n + 1) if b[i + n - 1] in masks]
    tails = [(i, len(b)) for i in range(len(b) - n + 1, len(b)) if b[i] in masks]
    for start, end in ends + whole + tails:
        if consider(start, end):
            break
    return best


def alignment(a: str, b: str) -> tuple[float, int, int, int, int]:
    """(score, start and end in a, start and end in b), counted from 0, ends left out."""
    if not a and not b:
        return 100.0, 0, 0, 0, 0
    if len(a) > len(b):
        score, s, e = _best_window(b, a) if b else (0.0, 0, 0)
        return score, s, e, 0, len(b)
    score, s, e = _best_window(a, b) if a else (0.0, 0, 0)
    if len(a) == len(b) and score < 100:
        other = _best_window(b, a)
        if other[0] > score:
            return other[0], other[1], other[2], 0, len(b)
    return score, 0, len(a), s, e


def partial_ratio(a: str, b: str) -> float:
    return alignment(a, b)[0]


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _parts(a: str, b: str) -> tuple[list[str], str, str]:
    s, t = set(a.split()), set(b.split())
    return sorted(s & t), " ".join(sorted(s - t)), " ".join(sorted(t - s))


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _parts(a, b)
    if both and (not left or not right):
        return 100.0
    shared = len(" ".join(both))
    gap = bool(shared)
    whole_a, whole_b = shared + gap + len(left), shared + gap + len(right)
    apart = len(left) + len(right) - 2 * _lcs(_masks(left), len(left), right)
    scores = [100 - 100 * apart / (whole_a + whole_b) if whole_a + whole_b else 100.0]
    if shared:
        scores += [100 - 100 * (gap + len(left)) / (shared + whole_a), 100 - 100 * (gap + len(right)) / (shared + whole_b)]
    return max(scores)


def token_ratio(a: str, b: str) -> float:
    return max(token_sort_ratio(a, b), token_set_ratio(a, b))


def partial_token_sort_ratio(a: str, b: str) -> float:
    return partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _parts(a, b)
    return 100.0 if both else partial_ratio(left, right)


def partial_token_ratio(a: str, b: str) -> float:
    return max(partial_token_sort_ratio(a, b), partial_token_set_ratio(a, b))


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    longer, base = max(len(a), len(b)) / min(len(a), len(b)), ratio(a, b)
    if longer < 1.5:
        return max(base, 0.95 * token_ratio(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(base, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def qratio(a: str, b: str) -> float:
    return ratio(a, b) if a and b else 0.0


SCORERS: dict[str, Callable[[str, str], float]] = {
    f.__name__: f
    for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio, token_ratio, partial_token_sort_ratio, partial_token_set_ratio, partial_token_ratio, wratio, qratio)
}


def score(a: str, b: str, name: str, cutoff: float) -> float:
    value = SCORERS[name](a, b)
    return value if value >= cutoff else 0.0


def aligned(a: str, b: str, cutoff: float) -> dict:
    value, s, e, t, f = alignment(a, b)
    if value < cutoff:
        return {"score": 0.0, "src_start": None, "src_end": None, "dest_start": None, "dest_end": None}
    return {"score": value, "src_start": s + 1, "src_end": e, "dest_start": t + 1, "dest_end": f}

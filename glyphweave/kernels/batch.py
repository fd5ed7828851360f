"""Similarity of many pairs of strings at once.

Pairs of a batch are sorted by length, padded and compared row by row of the dynamic programme, all pairs and
all columns of a row in one array operation; a row's running minimum or maximum is an accumulation. Pairs over
``LONG`` characters, rare in names, are taken in small groups, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Cells of a padded table that is held at a time.
CELLS = 1 << 19
PAD_A, PAD_B = -1, -2


def encode(texts: list[str], as_bytes: bool) -> list[np.ndarray]:
    """Each text as numbers of its bytes or code points."""
    if as_bytes:
        return [np.frombuffer(t.encode(), np.uint8).astype(np.int32) for t in texts]
    return [np.frombuffer(t.encode("utf-32-le"), np.int32) for t in texts]


def _padded(items: list[np.ndarray], width: int, pad: int) -> np.ndarray:
    out = np.full((len(items), width), pad, np.int32)
    for row, item in zip(out, items, strict=True):
        row[: len(item)] = item
    return out


def groups(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which pairs, padded a, padded b, lengths of a, lengths of b), pairs of like lengths together."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    order = np.lexsort((la, lb))
    at = 0
    while at < len(order):
        width = max(1, int(lb[order[at]]) + 4)
        n = max(1, CELLS // width)
        pick = order[at : at + n]
        pick = pick[lb[pick] <= width]
        wa, wb = int(la[pick].max()), int(lb[pick].max())
        yield pick, _padded([a[i] for i in pick], wa, PAD_A), _padded([b[i] for i in pick], wb, PAD_B), la[pick], lb[pick]
        at += len(pick)


def over_pairs(kernel: Callable, dtype: type = float) -> Callable:
    """Lift a kernel of padded groups to lists of texts."""

    def run(x: list[str], y: list[str], as_bytes: bool, *fixed: object) -> np.ndarray:
        a, b = encode(x, as_bytes), encode(y, as_bytes)
        out = np.zeros(len(x), dtype)
        for pick, pa, pb, la, lb in groups(a, b):
            out[pick] = kernel(pa, pb, la, lb, *fixed)
        return out

    return run


def jaro(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    n, wa = a.shape
    wb = b.shape[1]
    if not wa or not wb:
        return ((la == 0) & (lb == 0)).astype(float)
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used, matched = np.zeros((n, wb), bool), np.zeros((n, wa), bool)
    places, rows = np.arange(wb), np.arange(n)
    for i in range(wa):
        can = (b == a[:, i : i + 1]) & ~used & (np.abs(places - i) <= window[:, None])
        j = can.argmax(1)
        hit = can[rows, j]
        used[rows[hit], j[hit]] = True
        matched[:, i] = hit
    m = matched.sum(1)
    w = int(m.max())
    order_a, order_b = np.argsort(~matched, 1, kind="stable")[:, :w], np.argsort(~used, 1, kind="stable")[:, :w]
    differ = (np.take_along_axis(a, order_a, 1) != np.take_along_axis(b, order_b, 1)) & (np.arange(w) < m[:, None])
    t, some = differ.sum(1) / 2.0, m > 0
    safe = np.maximum(m, 1)
    value = (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (safe - t) / safe) / 3
    return np.where(some, value, ((la == 0) & (lb == 0)).astype(float))


def jaro_winkler(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, p: float = 0.1) -> np.ndarray:
    j, w = jaro(a, b, la, lb), min(4, a.shape[1], b.shape[1])
    prefix = np.cumprod(a[:, :w] == b[:, :w], 1).sum(1) if w else 0
    return j + prefix * p * (1 - j)


def _last(rows_done: np.ndarray, row: np.ndarray, i: int, la: np.ndarray, lb: np.ndarray) -> None:
    """Keep the result of the pairs whose first text ends at row i."""
    ends = np.flatnonzero(la == i)
    rows_done[ends] = row[ends, lb[ends]]


def levenshtein(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, insert: float = 1, delete: float = 1, substitute: float = 1) -> np.ndarray:
    steps = np.arange(b.shape[1] + 1) * float(insert)
    row, out = np.tile(steps, (len(a), 1)), np.zeros(len(a))
    _last(out, row, 0, la, lb)
    for i in range(a.shape[1]):
        new = row + delete
        np.minimum(new[:, 1:], row[:, :-1] + np.where(a[:, i : i + 1] == b, 0, substitute), out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, 1) + steps
        _last(out, row, i + 1, la, lb)
    return out


def osa(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    steps = np.arange(b.shape[1] + 1)
    before, row, out = None, np.tile(steps, (len(a), 1)), np.zeros(len(a))
    _last(out, row, 0, la, lb)
    for i in range(a.shape[1]):
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (a[:, i : i + 1] != b), out=new[:, 1:])
        if i and b.shape[1] > 1:
            swapped = (a[:, i : i + 1] == b[:, :-1]) & (a[:, i - 1 : i] == b[:, 1:])
            np.minimum(new[:, 2:], np.where(swapped, before[:, :-2] + 1, new[:, 2:]), out=new[:, 2:])
        before, row = row, np.minimum.accumulate(new - steps, 1) + steps
        _last(out, row, i + 1, la, lb)
    return out


def lcs_length(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    row, out = np.zeros((len(a), b.shape[1] + 1), np.int32), np.zeros(len(a))
    for i in range(a.shape[1]):
        new = row.copy()
        np.maximum(new[:, 1:], row[:, :-1] + (a[:, i : i + 1] == b), out=new[:, 1:])
        row = np.maximum.accumulate(new, 1)
        _last(out, row, i + 1, la, lb)
    return out


def needleman_wunsch(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, match: float = 1, mismatch: float = -1, gap: float = -1) -> np.ndarray:
    steps = np.arange(b.shape[1] + 1) * float(gap)
    row, out = np.tile(steps, (len(a), 1)), np.zeros(len(a))
    _last(out, row, 0, la, lb)
    for i in range(a.shape[1]):
        new = row + gap
        np.maximum(new[:, 1:], row[:, :-1] + np.where(a[:, i : i + 1] == b, match, mismatch), out=new[:, 1:])
        row = np.maximum.accumulate(new - steps, 1) + steps
        _last(out, row, i + 1, la, lb)
    return out


def smith_waterman(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, match: float = 1, mismatch: float = -2, gap_open: float = -0.5, gap_extend: float = -0.5) -> np.ndarray:
    """Best local score; gaps are affine, and opening costs at least as much as going on."""
    n, wb = len(a), b.shape[1]
    if not a.shape[1] or not wb:
        return np.zeros(n)
    inside = np.arange(wb) < lb[:, None]
    steps = np.arange(wb + 1) * float(gap_extend)
    row, down, best = np.zeros((n, wb + 1)), np.full((n, wb + 1), -np.inf), np.zeros(n)
    for i in range(a.shape[1]):
        down = np.maximum(row + gap_open, down + gap_extend)
        new = np.maximum(down, 0)
        np.maximum(new[:, 1:], row[:, :-1] + np.where(a[:, i : i + 1] == b, match, mismatch), out=new[:, 1:])
        new[:, 0] = 0
        across = np.maximum.accumulate(new - steps, 1)[:, :-1] + steps[1:] + (gap_open - gap_extend)
        np.maximum(new[:, 1:], across, out=new[:, 1:])
        row = new
        here = np.where(inside, row[:, 1:], 0).max(1)
        best = np.where(i < la, np.maximum(best, here), best)
    return best


def common_prefix(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    w = min(a.shape[1], b.shape[1])
    return np.cumprod(a[:, :w] == b[:, :w], 1).sum(1) if w else np.zeros(len(a))


#: Letters that sound alike in Editex; a letter may be in two groups.
EDITEX_GROUPS = ("AEIOUY", "BP", "CKQ", "DT", "LR", "MN", "GJ", "FPV", "SXZ", "CSZ")


def _editex_costs() -> np.ndarray:
    cost = np.full((128, 128), 2, np.int32)
    np.fill_diagonal(cost, 0)
    for group in EDITEX_GROUPS:
        for x in group:
            for y in group:
                if x != y:
                    cost[ord(x), ord(y)] = 1
    return cost


_EDITEX = _editex_costs()


def _editex_step(before: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Cost of deleting ``here`` after ``before``: 1 if that is a silent H or W, else their difference."""
    silent = np.isin(before, (72, 87)) & (before != here)
    p, q = np.clip(before, 0, 127), np.clip(here, 0, 127)
    other = np.where((before > 127) | (here > 127) | (before < 0) | (here < 0), np.where(before == here, 0, 2), _EDITEX[p, q])
    return np.where(silent, 1, other)


def editex(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Letters come as capitals."""
    n, wa, wb = len(a), a.shape[1], b.shape[1]
    blank = np.full((n, 1), 32, np.int32)
    step_a = _editex_step(np.concatenate([blank, a[:, :-1]], 1), a) if wa else np.zeros((n, 0), np.int32)
    step_b = _editex_step(np.concatenate([blank, b[:, :-1]], 1), b) if wb else np.zeros((n, 0), np.int32)
    across = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(step_b, 1)], 1)
    row, out = across.copy(), np.zeros(n)
    _last(out, row, 0, la, lb)
    for i in range(wa):
        new = row + step_a[:, i : i + 1]
        one = np.broadcast_to(a[:, i : i + 1], b.shape)
        change = np.where((one > 127) | (b > 127) | (one < 0) | (b < 0), np.where(one == b, 0, 2), _EDITEX[np.clip(one, 0, 127), np.clip(b, 0, 127)])
        np.minimum(new[:, 1:], row[:, :-1] + change, out=new[:, 1:])
        row = np.minimum.accumulate(new - across, 1) + across
        _last(out, row, i + 1, la, lb)
    return np.where((la == 0) | (lb == 0), 2.0 * (la + lb), out)

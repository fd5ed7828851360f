"""Literal sets, approximate search and case-setting substitution, one text at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from functools import lru_cache

import ahocorasick
import regex

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=16)
def _automaton(patterns: tuple[str, ...], fold: bool) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        p = p.translate(_FOLD) if fold else p
        if p not in out:  # the first of equal ones
            out.add_word(p, (i, len(p)))
    out.make_automaton()
    return out


def _leftmost(text: str, patterns: tuple[str, ...], fold: bool) -> Iterator[tuple[int, int, int]]:
    """(start, end, number) of matches from the left that do not overlap; the first of the list wins a start."""
    hits: dict[int, tuple[int, int]] = {}
    for end, (i, n) in _automaton(patterns, fold).iter(text.translate(_FOLD) if fold else text):
        start = end - n + 1
        if start not in hits or i < hits[start][0]:
            hits[start] = (i, n)
    free = 0
    for start in sorted(hits):
        if start >= free:
            i, n = hits[start]
            free = start + n
            yield start, free, i


def any_literal(text: str, patterns: tuple[str, ...], fold: bool) -> bool:
    return next(_automaton(patterns, fold).iter(text.translate(_FOLD) if fold else text), None) is not None


def count_literals(text: str, patterns: tuple[str, ...], fold: bool) -> int:
    return sum(1 for _ in _leftmost(text, patterns, fold))


def which_literal(text: str, patterns: tuple[str, ...], fold: bool) -> int | None:
    return min((i + 1 for _, (i, _) in _automaton(patterns, fold).iter(text.translate(_FOLD) if fold else text)), default=None)


def all_literals(text: str, patterns: tuple[str, ...], fold: bool) -> list[str]:
    return [text[a:b] for a, b, _ in _leftmost(text, patterns, fold)]


def first_literal(text: str, patterns: tuple[str, ...], fold: bool) -> str | None:
    return next((text[a:b] for a, b, _ in _leftmost(text, patterns, fold)), None)


def replace_literals(text: str, patterns: tuple[str, ...], replacements: tuple[str, ...], fold: bool) -> str:
    out, at = [], 0
    for a, b, i in _leftmost(text, patterns, fold):
        out += [text[at:a], replacements[i]]
        at = b
    return "".join(out) + text[at:]


def case_substitution(text: str, pattern: str, replacement: str, flags: int, first: bool) -> str:
    r"""Substitution whose replacement sets the case by \U, \L and \E."""

    def put(m: regex.Match) -> str:
        out, case = "", str
        for part in regex.findall(r"\\[0-9ULE]|\\.|[^\\]+|\\", replacement, regex.S):
            if part[:1] == "\\" and part[1:2] in ("U", "L", "E"):
                case = {"U": str.upper, "L": str.lower, "E": str}[part[1]]
            elif part[:1] == "\\" and part[1:].isdigit():
                out += case(m[int(part[1:])] or "")
            else:
                out += case(part[1:] if part[:1] == "\\" and len(part) > 1 else part)
        return out

    return regex.sub(pattern, put, text, count=1 if first else 0, flags=flags | regex.V0)


def edits_allowed(length: int, most: float) -> int:
    """A share under 1 of the pattern's length, rounded up."""
    return math.ceil(most * length) if most < 1 else int(most)


def within_edits(text: str, pattern: str, most: int, fold: bool) -> bool:
    """Whether some part of the text is within ``most`` edits of the pattern: bit-parallel dynamic programming."""
    if fold:
        text, pattern = text.lower(), pattern.lower()
    m = len(pattern)
    if most >= m:
        return True
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    top, full = 1 << (m - 1), (1 << m) - 1
    plus, minus, score = full, 0, m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | minus
        diagonal = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
        score += bool(up & top) - bool(down & top)
        if score <= most:
            return True
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
    return False


EDITS = ("insertions", "deletions", "substitutions")


def edit_limits(pattern: str, most: float | Mapping[str, float], costs: Mapping[str, int], fixed: bool) -> str:
    """An expression for the pattern within limits of cost and of each kind of edit."""
    unknown = (set(costs) - set(EDITS)) | (set(most) - {*EDITS, "cost", "all"} if isinstance(most, Mapping) else set())
    if unknown:
        raise ValueError(f"no such edits: {', '.join(sorted(unknown))}")
    cost, n = [int(costs.get(e, 1)) for e in EDITS], len(pattern)
    most = dict(most) if isinstance(most, Mapping) else {"cost": most}
    if "cost" not in most:
        most.setdefault("all", 0.1)
    share = lambda name, of: None if name not in most else math.ceil(most[name] * of) if most[name] < 1 else int(most[name])
    total, whole = share("cost", n * max(cost)), share("all", n)
    limits = [share(e, n) if e in most else whole for e in EDITS]
    free = len(pattern) + sum(x or 0 for x in [*limits, total, whole])
    parts = [f"{k}<={free if x is None else x}" for k, x in zip("ids", limits, strict=True)]
    if whole is not None:
        parts.append(f"e<={whole}")
    if total is not None:
        parts.append("+".join(f"{c}{k}" for c, k in zip(cost, "ids", strict=True)) + f"<={total}")
    return f"(?:{regex.escape(pattern) if fixed else pattern}){{{','.join(parts)}}}"


def within_limits(text: str, expression: str, fold: bool) -> bool:
    return regex.search(expression, text, flags=(regex.IGNORECASE if fold else 0) | regex.V0) is not None

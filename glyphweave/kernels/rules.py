"""Ordered rules by letter: what a name says at a place, in its context.

A rule is (mark, pattern, codes, letters passed). The pattern is matched at the letter's place and may look behind
and ahead; a mark restricts the rule to names that have it, and one with ``not`` to names that have it not. The
first rule that fits counts. All rules of a letter are one pattern, so a place costs one match.
"""

from __future__ import annotations

from collections.abc import Mapping

import regex

Rule = tuple[str, str, tuple[str, ...], int]


class RuleBook:
    def __init__(self, rules: Mapping[str, tuple[Rule, ...]]):
        self.rules = rules
        self.made: dict[tuple[str, frozenset[str]], tuple[regex.Pattern, list[Rule]]] = {}

    def _fitting(self, letter: str, marks: frozenset[str]) -> tuple[regex.Pattern, list[Rule]]:
        fits = lambda mark: not mark or (mark[4:] not in marks if mark.startswith("not ") else mark in marks)
        own = [r for r in self.rules[letter] if fits(r[0])]
        return regex.compile("|".join(f"({r[1]})" for r in own), regex.DOTALL), own

    def at(self, name: str, place: int, marks: frozenset[str] = frozenset()) -> tuple[tuple[str, ...], int]:
        """(codes, letters passed); no codes and one letter where no rule fits."""
        letter = name[place]
        if letter not in self.rules:
            return (), 1
        key = letter, marks
        if key not in self.made:
            self.made[key] = self._fitting(letter, marks)
        pattern, own = self.made[key]
        found = pattern.match(name, place)
        if found is None:
            return (), 1
        return own[found.lastindex - 1][2:]

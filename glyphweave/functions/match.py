"""Pattern matching, substitution and extraction on string columns.

Patterns are POSIX extended expressions unless ``perl`` or ``fixed`` is set or they use syntax that only
Perl's have; they are translated once, on the driver, and run inside the JVM. A null text, pattern or
replacement gives null. Case is folded for ASCII letters in literals and for all letters in expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache, reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

from glyphweave.functions.udf import ColumnLike, col, each
from glyphweave.kernels import search

#: Literals that are still tried one by one inside the JVM; more go to an automaton.
FEW = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PERL_ONLY = regex.compile(r"\(\?(?!i\))|[*+?}]\+|\\[QEKGAZzRXhHvVNgk]|\(\*")
_MAY_BE_EMPTY = regex.compile(r"[*?|^$]|\{0|\{,|\\b|^$")
_CLASSES = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Nd}", "alnum": r"\p{Alpha}\p{Nd}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "space": r"\s", "blank": r"\p{Blank}",
    "punct": r"\p{Punct}\p{S}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": "0-9A-Fa-f", "word": r"\w",
}


def _bracket(pattern: str, at: int, fold: bool) -> tuple[str, int]:
    """The bracket expression that starts at ``at``, for Java, and where it ends."""
    out, i = ["["], at + 1
    if pattern[i : i + 1] == "^":
        out.append("^")
        i += 1
    first = True
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and not first:
            return "".join(out) + "]", i + 1
        first = False
        if c == "[" and pattern[i + 1 : i + 2] == ":" and (end := pattern.find(":]", i)) > 0:
            name = pattern[i + 2 : end]
            if name not in _CLASSES:
                raise ValueError(f"unknown class [:{name}:]")
            out.append(r"\p{Lu}\p{Ll}\p{Lt}" if fold and name in ("upper", "lower") else _CLASSES[name])
            i = end + 2
            continue
        out.append("\\" + c if c in "[]\\&~^" else c)
        i += 1
    raise ValueError("a bracket is not closed")


def java_pattern(pattern: str, ignore_case: bool = False, perl: bool = False, fixed: bool = False) -> str:
    """The expression for java.util.regex."""
    if fixed:
        return ("(?i)" if ignore_case else "") + regex.sub(r"([\\^$.|?*+()\[\]{}&~-])", r"\\\1", pattern)
    if perl or _PERL_ONLY.search(pattern):
        if regex.search(r"\(\?(R|\d|&)|\(\*", pattern):
            raise ValueError("recursion and verbs have no counterpart here")
        return ("(?di)" if ignore_case else "(?d)") + pattern
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            out.append(r"\b(?=\w)" if n == "<" else r"\b(?<=\w)" if n == ">" else c + n)
            i += 2
        elif c == "[":
            text, i = _bracket(pattern, i, ignore_case)
            out.append(text)
        else:
            out.append(r"\z" if c == "$" else c)
            i += 1
    return ("(?sUiu)" if ignore_case else "(?sU)") + "".join(out)


def _flags(java: str) -> tuple[str, str]:
    flags, body = regex.match(r"(\(\?[a-zA-Z]+\))?(.*)", java, regex.S).groups()
    return flags or "", body


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def _null(kind: str) -> Column:
    return lit(None).cast(kind)


def fgrepl(pattern: str | None, x: ColumnLike, ignore_case: bool = False, perl: bool = False, fixed: bool = False) -> Column:
    """Whether the pattern occurs."""
    if pattern is None:
        return _null("boolean")
    if fixed:
        return F.contains(ascii_lower(col(x)), lit(pattern.translate(str.maketrans(UPPER, LOWER)))) if ignore_case else F.contains(col(x), lit(pattern))
    return col(x).rlike(java_pattern(pattern, ignore_case, perl))


def fgrep(df: DataFrame, pattern: str | None, x: ColumnLike, ignore_case: bool = False, perl: bool = False, fixed: bool = False, invert: bool = False) -> DataFrame:
    """Rows whose text matches; inverted, those that do not and those without a text."""
    hit = fgrepl(pattern, x, ignore_case, perl, fixed)
    return df.where(~F.coalesce(hit, lit(False)) if invert else hit)


def fcount(pattern: str | None, x: ColumnLike, ignore_case: bool = False, perl: bool = False, fixed: bool = False) -> Column:
    """Number of matches that do not overlap."""
    if pattern is None:
        return _null("int")
    java = java_pattern(pattern, ignore_case, perl, fixed)
    found = F.regexp_count(col(x), lit(java)).cast("int")
    return found if perl or fixed else F.when(col(x) == "", lit(0)).otherwise(found)


def _java_replacement(text: str, shift: int, fixed: bool) -> str:
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "\\" and not fixed and i + 1 < len(text):
            n = text[i + 1]
            out += f"${int(n) + shift}" if n.isdigit() else "\\" + n
            i += 2
            continue
        out += "\\" + c if c in "\\$" else c
        i += 1
    return out


def _cases(text: str) -> bool:
    return bool(regex.search(r"\\[ULE]", text))


def _sub(pattern: str | None, replacement: str | Column | None, x: ColumnLike, ignore_case: bool, perl: bool, fixed: bool, first: bool) -> Column:
    if pattern is None or replacement is None:
        return _null("string")
    if fixed and not pattern:
        raise ValueError("a literal pattern must not be empty")
    if not isinstance(replacement, str):
        raise TypeError("the replacement is one string")
    if fixed and not ignore_case and not first:
        return F.replace(col(x), lit(pattern), lit(replacement))
    java = java_pattern(pattern, ignore_case, perl, fixed)
    if not fixed and _cases(replacement):
        flags = (regex.I if ignore_case else 0) | (0 if perl else regex.S)
        return each("string", search.case_substitution, pattern, replacement, flags, first)(col(x))
    if first:
        flags, body = _flags(java)
        body = regex.sub(r"(?<!\\)((?:\\\\)*)\\([1-9])", lambda m: f"{m[1]}\\{int(m[2]) + 2}", body)
        return F.regexp_replace(col(x), rf"{flags}\A((?s:.*?))({body})", "$1" + _java_replacement(replacement, 2, fixed))
    if not fixed and _MAY_BE_EMPTY.search(pattern):
        flags, body = _flags(java)
        java = rf"{flags}(?:{body})(?:(?!\G)|(?<![\s\S]))"  # no empty match where a match has just ended
    return F.regexp_replace(col(x), java, _java_replacement(replacement, 0, fixed))


def fsub(pattern: str | None, replacement: str | None, x: ColumnLike, ignore_case: bool = False, perl: bool = False, fixed: bool = False) -> Column:
    """The first match replaced; ``\\1`` to ``\\9`` stand for groups, ``\\U``, ``\\L`` and ``\\E`` set the case."""
    return _sub(pattern, replacement, x, ignore_case, perl, fixed, True)


def fgsub(pattern: str | None, replacement: str | None, x: ColumnLike, ignore_case: bool = False, perl: bool = False, fixed: bool = False) -> Column:
    """All matches replaced."""
    return _sub(pattern, replacement, x, ignore_case, perl, fixed, False)


def gsub_all(patterns: Sequence[str | None], replacements: Sequence[str | None], x: ColumnLike, fixed: bool = False, ignore_case: bool = False, sequential: bool = True, perl: bool = False) -> Column:
    """Many replacements: one after the other, or (literals) in one scan in which the first of the list wins a place."""
    if len(replacements) == 1:
        replacements = list(replacements) * len(patterns)
    if len(patterns) != len(replacements):
        raise ValueError("as many replacements as patterns, or one")
    if any(p is None or r is None for p, r in zip(patterns, replacements, strict=True)):
        return _null("string")
    if sequential:
        return reduce(lambda c, pr: fgsub(pr[0], pr[1], c, ignore_case, perl, fixed), zip(patterns, replacements, strict=True), col(x))
    if not fixed:
        raise ValueError("one scan takes literals only")
    return each("string", search.replace_literals, tuple(patterns), tuple(replacements), ignore_case)(col(x))


def fextract(pattern: str | None, x: ColumnLike, ignore_case: bool = False, perl: bool = False, fixed: bool = False, group: int = 0) -> Column:
    """The first match or one of its groups; null if there is none or the group took no part."""
    if pattern is None:
        return _null("string")
    java = java_pattern(pattern, ignore_case, perl, fixed)
    found = F.regexp_extract(col(x), java, group)
    out = F.when(col(x).rlike(java), found)
    if group:
        flags, body = _flags(java)
        part = col(x).rlike(rf"{flags}\A(?>(?s:.*?)(?:{body}))(?=\{group})")  # an empty group took part if it can be referred to
        out = F.when(col(x).rlike(java) & ((found != "") | part), found)
    return out


def fextract_all(pattern: str | None, x: ColumnLike, ignore_case: bool = False, perl: bool = False, fixed: bool = False, group: int = 0) -> Column:
    """All matches; a null text gives an array of one null."""
    if pattern is None:
        return F.array(_null("string"))
    found = F.regexp_extract_all(col(x), lit(java_pattern(pattern, ignore_case, perl, fixed)), lit(group))
    return F.coalesce(found, F.array(_null("string")))


def _alternation(patterns: Sequence[str], ignore_case: bool) -> str:
    return ("(?i)" if ignore_case else "") + "|".join(java_pattern(p, fixed=True) for p in patterns)


@lru_cache(maxsize=64)
def _checked(patterns: tuple[str, ...]) -> tuple[str, ...]:
    if not patterns or any(not p for p in patterns):
        raise ValueError("give literals that are not empty")
    return patterns


def _literals(kind: str, kernel: Callable, patterns: Sequence[str], x: ColumnLike, ignore_case: bool) -> Column:
    return each(kind, kernel, _checked(tuple(patterns)), ignore_case)(col(x))


def fgrepl_any(patterns: Sequence[str], x: ColumnLike, ignore_case: bool = False) -> Column:
    """Whether any of the literals occurs."""
    if len(patterns) <= FEW:
        return col(x).rlike(_alternation(_checked(tuple(patterns)), ignore_case))
    return _literals("boolean", search.any_literal, patterns, x, ignore_case)


def fcount_any(patterns: Sequence[str], x: ColumnLike, ignore_case: bool = False) -> Column:
    """Number of leftmost matches that do not overlap; the first of the list wins a place."""
    if len(patterns) <= FEW:
        return F.regexp_count(col(x), lit(_alternation(_checked(tuple(patterns)), ignore_case))).cast("int")
    return _literals("int", search.count_literals, patterns, x, ignore_case)


def fwhich_any(patterns: Sequence[str], x: ColumnLike, ignore_case: bool = False) -> Column:
    """Number, from 1, of the first literal of the list that occurs anywhere."""
    if len(patterns) > FEW:
        return _literals("int", search.which_literal, patterns, x, ignore_case)
    return F.coalesce(*[F.when(fgrepl(p, x, ignore_case, fixed=True), lit(i)) for i, p in enumerate(_checked(tuple(patterns)), 1)], _null("int"))


def fextract_any(patterns: Sequence[str], x: ColumnLike, all: bool = False, ignore_case: bool = False) -> Column:  # noqa: A002
    """The first match of any literal as it stands in the text, or all of them."""
    if len(patterns) <= FEW:
        java = _alternation(_checked(tuple(patterns)), ignore_case)
        return F.coalesce(F.regexp_extract_all(col(x), lit(java), lit(0)), F.array(_null("string"))) if all else F.when(col(x).rlike(java), F.regexp_extract(col(x), java, 0))
    if all:
        return F.coalesce(_literals("array<string>", search.all_literals, patterns, x, ignore_case), F.array(_null("string")))
    return _literals("string", search.first_literal, patterns, x, ignore_case)


def fagrepl(
    pattern: str | None, x: ColumnLike, max_distance: float | Mapping[str, float] = 0.1, ignore_case: bool = False, fixed: bool = True, costs: Mapping[str, int] | None = None,
) -> Column:
    """Whether some part of the text is near enough to the literal or, with ``fixed`` off, to what the expression matches.

    A number limits the cost of all edits; under 1 it is a share of the pattern's length times the dearest edit. A
    mapping limits cost, insertions, deletions, substitutions and all edits; without a cost the
    limit of all edits is a tenth of the length, and that of each kind is that of all. ``costs`` are 1 unless given.
    """
    if pattern is None:
        return _null("boolean")
    if not pattern:
        raise ValueError("the pattern is empty")
    plain = not isinstance(max_distance, Mapping) and all(v == 1 for v in (costs or {}).values())
    if fixed and plain:
        return each("boolean", search.within_edits, pattern, search.edits_allowed(len(pattern), max_distance), ignore_case)(col(x))
    return each("boolean", search.within_limits, search.edit_limits(pattern, max_distance, costs or {}, fixed), ignore_case)(col(x))


def fagrep(
    df: DataFrame, pattern: str | None, x: ColumnLike, max_distance: float | Mapping[str, float] = 0.1, ignore_case: bool = False, fixed: bool = True, costs: Mapping[str, int] | None = None,
) -> DataFrame:
    """Rows where ``fagrepl`` holds."""
    return df.where(fagrepl(pattern, x, max_distance, ignore_case, fixed, costs))

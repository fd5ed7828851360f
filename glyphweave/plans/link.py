"""A whole linkage as one plan: keys, blocking, scores, staged filters and carried columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

from glyphweave.functions import compare as c
from glyphweave.functions import fuzz, phonetic
from glyphweave.functions import similarity as s
from glyphweave.functions.udf import col
from glyphweave.operators.blocking import Key, block_pairs, block_sizes, sorted_neighbourhood


@dataclass(frozen=True)
class Comparator:
    """A score of two columns; ``typed`` ones get the columns as they are, others as text in capitals."""

    score: Callable[..., Column]
    lower_is_match: bool = False
    typed: bool = False
    scale: float = 1.0


COMPARATORS = {
    **{n: Comparator(getattr(s, n)) for n in (
        "jaro_winkler", "jaro_winkler_tokens", "levenshtein_similarity", "osa_similarity", "damerau_levenshtein_similarity", "editex_similarity", "lcs_seq_similarity", "indel_similarity",
        "prefix_similarity", "postfix_similarity", "lcs_str_similarity", "smith_waterman", "needleman_wunsch_similarity", "monge_elkan", "ratcliff_obershelp", "bag_similarity",
        "jaccard_index", "dice_coefficient", "tversky_index", "overlap_coefficient", "cosine_similarity",
    )},
    **{n: Comparator(getattr(s, n + "_similarity")) for n in ("levenshtein", "damerau_levenshtein", "editex")},
    "osa_distance": Comparator(s.osa_similarity),
    **{f"fuzz_{n}": Comparator(getattr(fuzz, f"fuzz_{n}"), scale=100.0) for n in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "token_ratio", "wratio", "qratio")},
    "numeric_compare": Comparator(c.numeric_compare, typed=True), "date_compare": Comparator(c.date_compare, typed=True),
    "mra_compare": Comparator(lambda a, b: phonetic.mra_compare(a, b).cast("double")), "eudex_distance": Comparator(phonetic.eudex_distance, lower_is_match=True),
    "exact": Comparator(lambda a, b: (a == b).cast("double"), typed=True),
}


@dataclass(frozen=True)
class Compare:
    """Which column to score, against which of the other table, how, and under which name."""

    column: str
    by: str | Callable[[Column, Column], Column] = "jaro_winkler"
    other: str | None = None
    name: str | None = None
    options: dict = field(default_factory=dict)

    @property
    def output(self) -> str:
        return self.name or f"{self.column}_{self.by if isinstance(self.by, str) else self.by.__name__}"


@dataclass
class LinkResult:
    """Scored pairs, and how they were made."""

    df: DataFrame
    compare: list[Compare]
    dedupe: bool
    passes: int


def _key(df: DataFrame, key: Key, na_strings: Sequence[str], match_missing: bool) -> Key:
    """Terms of a key: texts in capitals, missing ones null; a lone number or date keeps its type."""
    terms, out = [key] if isinstance(key, (str, Column)) else list(key), []
    for t in terms:
        kind = df.select(col(t).alias("t")).schema["t"].dataType.simpleString()
        x = col(t)
        if kind == "string":
            x = F.upper(x)
            x = F.when(~x.isin(*[n.upper() for n in na_strings]), x) if na_strings else x
        elif len(terms) > 1:
            x = x.cast("string")
        out.append(F.coalesce(x.cast("string"), lit("\x00")) if match_missing else x)
    return out[0] if len(out) == 1 else out


def conjuncts(text: str) -> list[str]:
    """Parts of a condition between its outermost ands."""
    parts, depth, between, at = [], 0, 0, 0
    for m in re.finditer(r"\(|\)|'(?:[^']|'')*'|`[^`]*`|(?i:\bbetween\b|\band\b|\bcase\b|\bend\b|\bor\b)", text):
        word = m[0].lower()
        depth += {"(": 1, ")": -1, "case": 1, "end": -1}.get(word, 0)
        if depth:
            continue
        if word == "or":
            return [text.strip()]
        if word == "between":
            between += 1
        elif word == "and" and between:
            between -= 1
        elif word == "and":
            parts.append(text[at : m.start()])
            at = m.end()
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


def rlink(
    data_1: DataFrame, id_1: str, block_1: Sequence[Key], data_2: DataFrame | None = None, id_2: str | None = None, block_2: Sequence[Key] | None = None, compare: Sequence[Compare] = (),
    pairs: DataFrame | None = None, block_method: str = "exact", window: int = 3, max_block_size: float | None = None, match_missing: bool = False, na_strings: Sequence[str] = ("",),
    filter: str | None = None, exclude: DataFrame | None = None, keep: Sequence[str] = (), pair_id: bool = False, max_pairs: int | None = None,  # noqa: A002
) -> LinkResult:
    """Pairs of two tables (or of one with itself) that agree on a key, scored, filtered, with carried columns.

    Scores stand under ``<column>_<comparator>``, 1 for a match unless their comparator is a plain distance. A
    filter is taken apart at its ands: each part runs as soon as its scores are there, and the scores that it does not
    need come later, on fewer pairs. Values are cleaned once a record and go through the blocking join, so pairs are scored
    and filtered where they arise and only those that stay are shuffled; kept columns are joined to them last.
    ``pairs`` (x_id, y_id) replaces blocking. With ``max_pairs`` the expected number is counted first.
    """
    dedupe, other = data_2 is None, data_1 if data_2 is None else data_2
    own, their = id_1, id_2 or id_1

    def values(side: int) -> dict[str, Column]:
        """What is compared of one side, cleaned once a record."""
        out = {}
        for x in compare:
            name = x.column if side == 1 else x.other or x.column
            typed = isinstance(x.by, str) and COMPARATORS[x.by].typed
            text = F.upper(F.col(name).cast("string"))
            out[f"__{side}_{name}_{typed}"] = F.col(name) if typed else F.when(~text.isin(*na_strings), text) if na_strings else text
        return out

    carried = pairs is None and block_method == "exact"
    if pairs is None:
        k1 = [_key(data_1, k, na_strings, match_missing) for k in block_1]
        k2 = [_key(other, k, na_strings, match_missing) for k in (block_1 if block_2 is None else block_2)]
        if max_pairs is not None and block_method == "exact":
            expected = sum(block_sizes(data_1, own, a, data_2, their, b).agg(F.sum("pairs")).first()[0] or 0 for a, b in zip(k1, k2, strict=True))
            if expected > max_pairs:
                raise ValueError(f"{expected} pairs are expected, more than {max_pairs}")
        if block_method == "exact":
            found = block_pairs(data_1, k1, own, data_2, k2, their, max_block_size, values(1), values(2))
        else:
            found = sorted_neighbourhood(data_1, k1, own, data_2, k2, their, window)
    else:
        found = pairs if "pass" in pairs.columns else pairs.withColumn("pass", lit(0))
    if exclude is not None:
        gone = exclude.select("x_id", "y_id")
        gone = gone.unionByName(gone.select(F.col("y_id").alias("x_id"), F.col("x_id").alias("y_id"))) if dedupe else gone
        found = found.join(gone.distinct(), ["x_id", "y_id"], "left_anti")

    scored = found
    if compare and not carried:
        for side, df, id_col, end in ((1, data_1, own, "x_id"), (2, other, their, "y_id")):
            scored = scored.join(df.select(F.col(id_col).alias(end), *[v.alias(k) for k, v in values(side).items()]), end)
    parts, waiting, done = conjuncts(filter) if filter else [], list(compare), {"pass", "x_id", "y_id"}
    needs = {p: {x.output for x in compare if re.search(rf"(?<!\w){re.escape(x.output)}(?!\w)", p)} for p in parts}

    def score(df: DataFrame, x: Compare) -> DataFrame:
        typed = isinstance(x.by, str) and COMPARATORS[x.by].typed
        a, b = F.col(f"__1_{x.column}_{typed}"), F.col(f"__2_{x.other or x.column}_{typed}")
        kind = COMPARATORS[x.by] if isinstance(x.by, str) else Comparator(x.by)
        value = kind.score(a, b, **x.options)
        return df.withColumn(x.output, value / kind.scale if kind.scale != 1 else value)

    for part in sorted(parts, key=lambda p: len(needs[p])):
        for x in [x for x in waiting if x.output in needs[part]]:
            scored, waiting = score(scored, x), [w for w in waiting if w is not x]
            done.add(x.output)
        scored = scored.where(F.expr(part))
    for x in waiting:
        scored = score(scored, x)
    columns = ["x_id", "y_id", "pass", *[x.output for x in compare]]
    out = scored.select(*columns)
    for side, df, id_col in ((1, data_1, own), (2, other, their)):
        here = [k for k in keep if k in df.columns]
        if here:
            end = "x_id" if side == 1 else "y_id"
            out = out.join(df.select(F.col(id_col).alias(end), *[F.col(k).alias(f"{k}_{side}") for k in here]), end)
            columns += [f"{k}_{side}" for k in here]
    out = out.select(*columns)
    if pair_id:
        texts = [F.col(x).cast("string") for x in ("x_id", "y_id")]
        bad = F.raise_error(lit("an id holds |"))
        out = out.withColumn("pair_id", F.when(F.contains(texts[0], lit("|")) | F.contains(texts[1], lit("|")), bad).otherwise(F.concat_ws("|", *texts)))
    return LinkResult(out, list(compare), dedupe, len(block_1) if pairs is None else 0)

"""Distances and similarities of two string columns, and of all pairs of two tables.

Characters are bytes where ``use_bytes`` says so: a text's bytes are then read as so many Latin-1 characters,
so that the JVM's own functions count them. Null in either text gives null. Similarities of two empty texts are 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

from glyphweave.functions.udf import ColumnLike, col, each, once, pairs
from glyphweave.functions.unicode import native_fold
from glyphweave.kernels import pairwise as k


def units(x: ColumnLike, use_bytes: bool) -> Column:
    """The text, with each byte as one character if bytes count."""
    y = col(x)
    return F.when(F.octet_length(y) == F.char_length(y), y).otherwise(F.decode(F.encode(y, "UTF-8"), "ISO-8859-1")) if use_bytes else y


def _longest(a: Column, b: Column) -> Column:
    return F.greatest(F.char_length(a), F.char_length(b))


def _similar(distance: Column, longest: Column) -> Column:
    return F.when(longest == 0, lit(1.0)).otherwise(F.greatest(lit(0.0), 1 - distance / longest))


def jaro_winkler(a: ColumnLike, b: ColumnLike, p: float = 0.1, use_bytes: bool = True) -> Column:
    return pairs("double", k.jaro_winkler, use_bytes, p)(a, b)


def jaro_winkler_tokens(a: ColumnLike, b: ColumnLike, p: float = 0.1, ignore_case: bool = False, strip: str | None = k._STRIP, extra_penalty: float | None = None, contractions: bool = False) -> Column:
    return pairs("double", k.jaro_winkler_tokens, p, ignore_case, strip, extra_penalty, contractions)(a, b)


def levenshtein(a: ColumnLike, b: ColumnLike, use_bytes: bool = True, weights: tuple[float, float, float] = (1, 1, 1)) -> Column:
    """Edits between two texts; weights are those of insertion, deletion and substitution."""
    if tuple(weights) == (1, 1, 1):
        return F.levenshtein(units(a, use_bytes), units(b, use_bytes)).cast("double")
    return pairs("double", k.levenshtein, use_bytes, *map(float, weights))(a, b)


def levenshtein_similarity(a: ColumnLike, b: ColumnLike, use_bytes: bool = True, weights: tuple[float, float, float] = (1, 1, 1)) -> Column:
    """1 - edits / longer length; with weights, over the cost of the dearest way."""
    x, y = units(a, use_bytes), units(b, use_bytes)
    if tuple(weights) == (1, 1, 1):
        return _similar(levenshtein(a, b, use_bytes), _longest(x, y))
    insert, delete, substitute = weights
    la, lb = F.char_length(x), F.char_length(y)
    short = F.least(la, lb)
    most = F.least(la * delete + lb * insert, short * substitute + (la - short) * delete + (lb - short) * insert)
    return F.when(most == 0, lit(1.0)).otherwise(F.greatest(lit(0.0), 1 - levenshtein(a, b, use_bytes, weights) / most))


def levenshtein_within(a: ColumnLike, b: ColumnLike, max_distance: int, use_bytes: bool = True) -> Column:
    return F.levenshtein(units(a, use_bytes), units(b, use_bytes), max_distance) != -1


def osa_distance(a: ColumnLike, b: ColumnLike, use_bytes: bool = True) -> Column:
    """Edits and swaps of neighbours, no part edited twice."""
    return pairs("double", k.osa, use_bytes)(a, b)


def osa_similarity(a: ColumnLike, b: ColumnLike, use_bytes: bool = True) -> Column:
    return _similar(osa_distance(a, b, use_bytes), _longest(units(a, use_bytes), units(b, use_bytes)))


def damerau_levenshtein(a: ColumnLike, b: ColumnLike, use_bytes: bool = True) -> Column:
    """Edits and swaps, without that limit."""
    return each("double", k.damerau, use_bytes)(col(a), col(b))


def damerau_levenshtein_similarity(a: ColumnLike, b: ColumnLike, use_bytes: bool = True) -> Column:
    return _similar(damerau_levenshtein(a, b, use_bytes), _longest(units(a, use_bytes), units(b, use_bytes)))


def hamming(a: ColumnLike, b: ColumnLike, use_bytes: bool = True) -> Column:
    """Places that differ; infinite for texts of unequal length."""
    x, y = units(a, use_bytes), units(b, use_bytes)
    chars = lambda c: F.regexp_extract_all(c, lit("(?s)."), lit(0))
    differ = F.aggregate(F.zip_with(chars(x), chars(y), lambda p, q: (p != q).cast("int")), lit(0), lambda s, d: s + d)
    return F.when(x.isNotNull() & y.isNotNull(), F.when(F.char_length(x) == F.char_length(y), differ.cast("double")).otherwise(lit(float("inf"))))


def edit_steps(a: ColumnLike, b: ColumnLike, type: str = "editops", use_bytes: bool = False) -> Column:  # noqa: A002
    """The edits (or blocks of edits and equal parts) as an array, in their order: type and places from 1 in both texts."""
    if type not in ("editops", "opcodes"):
        raise ValueError("type is editops or opcodes")
    kind = "array<struct<type:string,a_start:int,a_end:int,b_start:int,b_end:int>>"
    return each(kind, k.edit_ops, type == "opcodes", use_bytes)(col(a), col(b))


def edit_rows(df: DataFrame, id_col: str, steps: str) -> DataFrame:
    """One row an element of ``edit_steps``, numbered from 1."""
    found = df.select(F.col(id_col), F.posexplode(steps).alias("step", "op"))
    return found.select(id_col, (F.col("step") + 1).alias("step"), "op.*")


def edit_ops(df: DataFrame, a: ColumnLike, b: ColumnLike, id_col: str, type: str = "editops", use_bytes: bool = False) -> DataFrame:  # noqa: A002
    """One row an edit (or block of edits and equal parts): id, step, type and places from 1 in both texts."""
    return edit_rows(df.select(id_col, edit_steps(a, b, type, use_bytes).alias("steps")), id_col, "steps")


def editex(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    """Edits that cost less between letters that sound alike."""
    return pairs("double", k.editex, use_bytes)(native_fold(col(a)), native_fold(col(b)))


def editex_similarity(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    x, y = (units(native_fold(col(c)), use_bytes) for c in (a, b))
    return _similar(editex(a, b, use_bytes), 2 * _longest(x, y))


def _lcs(a: ColumnLike, b: ColumnLike, use_bytes: bool) -> Column:
    return pairs("double", k.lcs_length, use_bytes)(a, b)


def lcs_seq_distance(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    return _longest(units(a, use_bytes), units(b, use_bytes)) - _lcs(a, b, use_bytes)


def lcs_seq_similarity(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    return _similar(lcs_seq_distance(a, b, use_bytes), _longest(units(a, use_bytes), units(b, use_bytes)))


def indel_distance(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    """Insertions and deletions only."""
    return F.char_length(units(a, use_bytes)) + F.char_length(units(b, use_bytes)) - 2 * _lcs(a, b, use_bytes)


def indel_similarity(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    return _similar(indel_distance(a, b, use_bytes), F.char_length(units(a, use_bytes)) + F.char_length(units(b, use_bytes)))


def _common(a: ColumnLike, b: ColumnLike, use_bytes: bool, end: bool) -> Column:
    x, y = units(a, use_bytes), units(b, use_bytes)
    x, y = (F.reverse(x), F.reverse(y)) if end else (x, y)
    n = F.least(F.char_length(x), F.char_length(y))
    places = F.when(n > 0, F.sequence(lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.when(x.isNotNull() & y.isNotNull(), F.size(F.filter(places, lambda i: F.left(x, i) == F.left(y, i))))


def prefix_distance(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    """Longer length - common characters at the start."""
    return (_longest(units(a, use_bytes), units(b, use_bytes)) - _common(a, b, use_bytes, False)).cast("double")


def prefix_similarity(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    return _similar(prefix_distance(a, b, use_bytes), _longest(units(a, use_bytes), units(b, use_bytes)))


def postfix_distance(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    """Longer length - common characters at the end."""
    return (_longest(units(a, use_bytes), units(b, use_bytes)) - _common(a, b, use_bytes, True)).cast("double")


def postfix_similarity(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    return _similar(postfix_distance(a, b, use_bytes), _longest(units(a, use_bytes), units(b, use_bytes)))


def lcs_str(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    """The longest common run of characters."""
    return each("string", k.longest_common, use_bytes)(col(a), col(b))


def lcs_str_similarity(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    longest = _longest(units(a, use_bytes), units(b, use_bytes))
    return F.when(longest == 0, lit(1.0)).otherwise(F.char_length(units(lcs_str(a, b, use_bytes), use_bytes)) / longest)


def smith_waterman(a: ColumnLike, b: ColumnLike, match: float = 1, mismatch: float = -2, gap_open: float = -0.5, gap_extend: float | None = None, normalize: bool = True, use_bytes: bool = False) -> Column:
    """Best score of parts of both texts; normalised, over that of the whole shorter text."""
    extend = gap_open if gap_extend is None else gap_extend
    if gap_open > extend:
        raise ValueError("opening a gap costs at least as much as going on")
    score = pairs("double", k.smith_waterman, use_bytes, float(match), float(mismatch), float(gap_open), float(extend))(a, b)
    if not normalize:
        return score
    la, lb = F.char_length(units(a, use_bytes)), F.char_length(units(b, use_bytes))
    return F.when((la == 0) & (lb == 0), lit(1.0)).when((la == 0) | (lb == 0), lit(0.0)).otherwise(score / (F.least(la, lb) * match))


def needleman_wunsch(a: ColumnLike, b: ColumnLike, match: float = 1, mismatch: float = -1, gap: float = -1, use_bytes: bool = False) -> Column:
    """Score of an alignment of both whole texts."""
    return pairs("double", k.needleman_wunsch, use_bytes, float(match), float(mismatch), float(gap))(a, b)


def needleman_wunsch_similarity(a: ColumnLike, b: ColumnLike, match: float = 1, mismatch: float = -1, gap: float = -1, use_bytes: bool = False) -> Column:
    """The score between the worst and the best that texts of these lengths can have."""
    la, lb = F.char_length(units(a, use_bytes)), F.char_length(units(b, use_bytes))
    short, long = F.least(la, lb), F.greatest(la, lb)
    worst, best = F.least(short * mismatch + (long - short) * gap, (la + lb) * gap), long * match
    value = (needleman_wunsch(a, b, match, mismatch, gap, use_bytes) - worst) / (best - worst)
    return F.when(long == 0, lit(1.0)).when(best == worst, lit(0.0)).otherwise(F.least(lit(1.0), F.greatest(lit(0.0), value)))


def monge_elkan(a: ColumnLike, b: ColumnLike, method: str = "jaro_winkler", p: float = 0.1, symmetric: bool = False, use_bytes: bool = False) -> Column:
    return pairs("double", k.monge_elkan, method, p, symmetric, use_bytes)(a, b)


def ratcliff_obershelp(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    """Share of characters in common runs, found from the longest on."""
    return pairs("double", k.gestalt, use_bytes)(a, b)


def ratcliff_obershelp_distance(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    return 1 - ratcliff_obershelp(a, b, use_bytes)


def bag_distance(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    """Characters of either text that the other lacks, the larger number."""
    return pairs("double", k.bag, use_bytes)(a, b)


def bag_similarity(a: ColumnLike, b: ColumnLike, use_bytes: bool = False) -> Column:
    return _similar(bag_distance(a, b, use_bytes), _longest(units(a, use_bytes), units(b, use_bytes)))


def grams(x: Column, q: int) -> Column:
    """All runs of q characters; none of a shorter text."""
    last = F.char_length(x) - (q - 1)
    return F.when(last >= 1, F.transform(F.sequence(lit(1), last), lambda i: F.substring(x, i, lit(q)))).when(x.isNotNull(), F.array().cast("array<string>"))


def _sets(a: ColumnLike, b: ColumnLike, q: int, use_bytes: bool, measure: Callable[[Column, Column, Column], Column]) -> Column:
    if q < 1:
        raise ValueError("q is at least 1")
    x, y = units(a, use_bytes), units(b, use_bytes)
    sets = once(F.struct(x.alias("a"), y.alias("b")), lambda t: F.struct(*[F.array_distinct(grams(t[k], q)).alias(k) for k in "ab"]))
    sizes = once(sets, lambda t: F.array(F.size(F.array_intersect(t["a"], t["b"])), F.size(t["a"]), F.size(t["b"])))
    value = once(sizes, lambda n: measure(n[0], n[1], n[2]))
    return F.when(x == y, lit(1.0)).when(x.isNotNull() & y.isNotNull(), F.coalesce(value, lit(0.0)))


def _over(x: Column, y: Column) -> Column:
    return F.when(y != 0, x / y)


def jaccard_index(a: ColumnLike, b: ColumnLike, q: int = 2, use_bytes: bool = True) -> Column:
    return _sets(a, b, q, use_bytes, lambda both, s, t: _over(both, s + t - both))


def dice_coefficient(a: ColumnLike, b: ColumnLike, q: int = 2, use_bytes: bool = True) -> Column:
    return _sets(a, b, q, use_bytes, lambda both, s, t: _over(2 * both, s + t))


def tversky_index(a: ColumnLike, b: ColumnLike, q: int = 2, alpha: float = 0.5, beta: float = 0.5, use_bytes: bool = True) -> Column:
    return _sets(a, b, q, use_bytes, lambda both, s, t: _over(both, both + alpha * (s - both) + beta * (t - both)))


def overlap_coefficient(a: ColumnLike, b: ColumnLike, q: int = 2, use_bytes: bool = True) -> Column:
    return _sets(a, b, q, use_bytes, lambda both, s, t: _over(both, F.least(s, t)))


def cosine_similarity(a: ColumnLike, b: ColumnLike, q: int = 2, use_bytes: bool = True) -> Column:
    """Cosine of the counts of runs of q characters."""
    return pairs("double", k.gram_measure, "cosine", q, use_bytes)(a, b)


def matrix(measure: Callable[[ColumnLike, ColumnLike], Column], left: DataFrame, right: DataFrame, id_left: str, text_left: str, id_right: str, text_right: str) -> DataFrame:
    """All pairs of two tables in long form: row_id, col_id, score. Different texts are scored once each, however often they stand there.

    The result itself has rows x columns cells, so this is for tables whose product is wanted.
    """
    a, b = left.select(F.col(text_left).alias("a")).distinct(), right.select(F.col(text_right).alias("b")).distinct()
    cells = a.crossJoin(b).select("a", "b", measure("a", "b").alias("score"))
    rows = left.select(F.col(id_left).alias("row_id"), F.col(text_left).alias("a_row"))
    columns = right.select(F.col(id_right).alias("col_id"), F.col(text_right).alias("b_col"))
    return rows.join(cells, F.col("a_row").eqNullSafe(F.col("a"))).join(columns, F.col("b_col").eqNullSafe(F.col("b"))).select("row_id", "col_id", "score")


def matrix_of(measure: Callable[..., Column], **fixed: object) -> Callable[..., DataFrame]:
    """The all-pairs form of a measure."""
    return lambda left, right, id_left, text_left, id_right, text_right: matrix(lambda a, b: measure(a, b, **fixed), left, right, id_left, text_left, id_right, text_right)


jaro_winkler_matrix, levenshtein_matrix, osa_distance_matrix, damerau_levenshtein_matrix = map(matrix_of, (jaro_winkler, levenshtein, osa_distance, damerau_levenshtein))
jaccard_matrix, dice_matrix, tversky_matrix, overlap_matrix, cosine_matrix = map(matrix_of, (jaccard_index, dice_coefficient, tversky_index, overlap_coefficient, cosine_similarity))

"""Scores from 0 to 100 of two string columns. A score below the cut-off is 0; null in either gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphweave.functions.udf import ColumnLike, col, each
from glyphweave.kernels import fuzz as kernels


def fuzz_default_process(x: ColumnLike) -> Column:
    """Small letters and digits; all else a blank, none at the ends."""
    return F.trim(F.lower(F.regexp_replace(col(x), r"[^\p{L}\p{N}]", " ")))


def fuzz_cpdist(a: ColumnLike, b: ColumnLike, scorer: str = "ratio", full_process: bool = True, score_cutoff: float = 0) -> Column:
    """The score by the scorer of this name."""
    if scorer not in kernels.SCORERS:
        raise ValueError(f"scorer is one of {', '.join(kernels.SCORERS)}")
    x, y = (fuzz_default_process(c) if full_process else col(c) for c in (a, b))
    return each("double", kernels.score, scorer, float(score_cutoff))(x, y)


def _named(scorer: str, says: str) -> Callable[..., Column]:
    def score(a: ColumnLike, b: ColumnLike, full_process: bool = True, score_cutoff: float = 0) -> Column:
        return fuzz_cpdist(a, b, scorer, full_process, score_cutoff)

    score.__name__, score.__doc__ = f"fuzz_{scorer}", says
    return score


fuzz_ratio = _named("ratio", "Share of the characters that a common subsequence has.")
fuzz_partial_ratio = _named("partial_ratio", "The best ratio of the shorter text with a part of the longer.")
fuzz_token_sort_ratio = _named("token_sort_ratio", "The ratio of the sorted words.")
fuzz_token_set_ratio = _named("token_set_ratio", "The best ratio of common words with all words of either side.")
fuzz_token_ratio = _named("token_ratio", "The better of the two scores of sorted words and of sets of words.")
fuzz_partial_token_sort_ratio = _named("partial_token_sort_ratio", "The partial ratio of the sorted words.")
fuzz_partial_token_set_ratio = _named("partial_token_set_ratio", "100 with a common word, else the partial ratio of the words.")
fuzz_partial_token_ratio = _named("partial_token_ratio", "The better of both partial scores of words.")
fuzz_wratio = _named("wratio", "The best of the scores that suit the lengths, weighted.")
fuzz_qratio = _named("qratio", "The ratio, 0 if either text is empty.")


def fuzz_partial_ratio_alignment(a: ColumnLike, b: ColumnLike, full_process: bool = True, score_cutoff: float = 0) -> Column:
    """The partial ratio and the aligned parts, places from 1 to the last one; below the cut-off score 0 and no places."""
    x, y = (fuzz_default_process(c) if full_process else col(c) for c in (a, b))
    return each("struct<score:double,src_start:int,src_end:int,dest_start:int,dest_end:int>", kernels.aligned, float(score_cutoff))(x, y)

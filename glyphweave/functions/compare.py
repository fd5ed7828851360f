"""Comparators of numbers, dates and places, and levels of agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

from glyphweave.functions.udf import ColumnLike, col

METHODS = ("linear", "exp", "gauss", "squared", "step")
#: Mean radius of the earth.
RADIUS = {"km": 6371.0088, "m": 6371008.8, "mi": 3958.7613, "nm": 3440.0695}


def _curve(d: Column, method: str, offset: float, scale: float) -> Column:
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    past = F.greatest(d - offset, lit(0.0))
    return {
        "step": (d <= offset).cast("double"), "linear": 1 - F.least(past, lit(2.0 * scale)) / (2 * scale), "exp": F.pow(lit(2.0), -past / scale),
        "squared": 1 - F.pow(F.least(past, lit(2**0.5 * scale)), lit(2.0)) / (2 * scale * scale), "gauss": F.pow(lit(2.0), -F.pow(past / scale, lit(2.0))),
    }[method]


def numeric_compare(a: ColumnLike, b: ColumnLike, method: str = "linear", offset: float = 0, scale: float = 1, origin: float = 0, missing_value: float | None = None) -> Column:
    """1 for numbers ``origin`` apart, give or take ``offset``; one half at ``scale`` beyond, by a curve."""
    value = _curve(F.abs(F.abs(col(a).cast("double") - col(b).cast("double")) - origin), method, offset, scale)
    return value if missing_value is None else F.coalesce(value, lit(float(missing_value)))


def _one_edit(x: Column, y: Column) -> Column:
    """Whether two years of four digits are one edit or swap of neighbours apart."""
    swapped = lit(False)
    for i in (1, 2, 3):
        new = F.concat(F.substring(x, 1, i - 1), F.substring(x, i + 1, 1), F.substring(x, i, 1), F.substring(x, i + 2, 4))
        swapped = swapped | (new == y)
    return (x != y) & ((F.levenshtein(x, y) == 1) | swapped)


def date_compare(
    a: ColumnLike, b: ColumnLike, method: str = "exp", offset: float = 0, scale: float = 30, origin: float = 0, swap_score: float | None = 0.5, year_typo_score: float | None = 0.5, missing_value: float | None = None,
) -> Column:
    """Closeness in days, but at least ``swap_score`` for a swapped day and month, ``year_typo_score`` for one slip in the year."""
    x, y = col(a).cast("date"), col(b).cast("date")
    value = numeric_compare(F.datediff(x, y), lit(0), method, offset, scale, origin)
    scores = [value]
    if swap_score is not None:
        swapped = (F.year(x) == F.year(y)) & (F.month(x) == F.day(y)) & (F.day(x) == F.month(y))
        scores.append(F.when(swapped, lit(float(swap_score))).otherwise(0.0))
    if year_typo_score is not None:
        slip = _one_edit(F.date_format(x, "yyyy"), F.date_format(y, "yyyy")) & (F.month(x) == F.month(y)) & (F.day(x) == F.day(y))
        scores.append(F.when(slip, lit(float(year_typo_score))).otherwise(0.0))
    value = F.when(x == y, lit(1.0)).when(x.isNotNull() & y.isNotNull(), F.greatest(*scores) if len(scores) > 1 else value)
    return value if missing_value is None else F.coalesce(value, lit(float(missing_value)))


def geo_distance(lat_1: ColumnLike, lon_1: ColumnLike, lat_2: ColumnLike, lon_2: ColumnLike, unit: str = "km", radius: float | None = None) -> Column:
    """Great-circle distance of places in degrees."""
    p, q = F.radians(col(lat_1)), F.radians(col(lat_2))
    h = F.pow(F.sin((q - p) / 2), lit(2.0)) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(col(lon_2)) - F.radians(col(lon_1))) / 2), lit(2.0))
    return 2 * (RADIUS[unit] if radius is None else radius) * F.asin(F.sqrt(F.when(h > 1, lit(1.0)).otherwise(h)))


def compare_levels(x: ColumnLike, breaks: Sequence[float], decreasing: bool = False) -> Column:
    """Level 0 to k: how many of the breaks are reached; decreasing, small values have high levels."""
    if not breaks or any(b >= c for b, c in zip(breaks, breaks[1:], strict=False)):
        raise ValueError("breaks rise")
    level = sum((F.when(col(x) >= b, 1).otherwise(0) for b in breaks), lit(0))
    return F.when(col(x).isNotNull(), (len(breaks) - level) if decreasing else level)


def tf_adjust(weight: ColumnLike, u: ColumnLike | float, frequency_1: ColumnLike, frequency_2: ColumnLike | None = None, weight_power: float = 1) -> Column:
    """A weight corrected for how frequent the agreeing value is in both tables."""
    if weight_power < 0:
        raise ValueError("the power is not negative")
    chance = lit(u) if isinstance(u, float) else col(u)
    return col(weight) + weight_power * F.log2(chance / (col(frequency_1) * col(frequency_1 if frequency_2 is None else frequency_2)))

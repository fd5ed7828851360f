"""Strict dates and timestamps in fixed layouts. What does not fit or is no calendar date gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

from glyphweave.functions.udf import ColumnLike, col

#: Layout -> (shape, how it is written, the fields it reads).
LAYOUTS = {
    "iso": (r"\d{4}-\d\d-\d\d", "yyyy-MM-dd", "ymd"), "compact": (r"\d{8}", "yyyyMMdd", "ymd"), "dmy": (r"\d\d/\d\d/\d{4}", "dd/MM/yyyy", "dmy"),
    "ymd_slash": (r"\d{4}/\d\d/\d\d", "yyyy/MM/dd", "ymd"), "y": (r"\d{4}", "yyyy", "y"), "m": (r"\d\d", "MM", "m"), "d": (r"\d\d", "dd", "d"),
    "y-m": (r"\d{4}-\d\d", "yyyy-MM", "ym"), "m-d": (r"\d\d-\d\d", "MM-dd", "md"),
}
#: Day 0 of each epoch as days since 1970-01-01, and what is added to a count before it is floored; spss counts seconds.
EPOCHS = {
    "unix": (0, 0.0), "excel": (-25569, 0.0), "excel1904": (-24107, 0.0), "sas": (-3653, 0.0), "stata": (-3653, 0.0), "spss": (-141428, 0.0),
    "matlab": (-719529, 0.0), "julian_day": (-2440588, 0.5), "mjd": (-40587, 0.0), "rata_die": (-719163, 0.0),
}


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")


def fas_date(x: ColumnLike, format: str = "iso") -> Column:  # noqa: A002
    """Texts as dates; missing fields are those of 1970-01-01."""
    shape, _, fields = LAYOUTS[format]
    at, got = 1, {"y": lit("1970"), "m": lit("01"), "d": lit("01")}
    for f in fields:
        n = 4 if f == "y" else 2
        got[f] = F.substring(col(x), at, n)
        at += n + (format != "compact")
    return F.when(col(x).rlike(rf"\A{shape}\z"), _iso(got["y"], got["m"], got["d"]))


def fas_date_count(x: ColumnLike, origin: str = "unix") -> Column:
    """Counts from an epoch as dates; an origin may be a date like 1900-01-01. Fractions are floored."""
    n = col(x).cast("double")
    good = ~F.isnan(n) & (F.abs(n) < 1e9 * (86400 if origin == "spss" else 1))
    if origin not in EPOCHS:
        return F.when(good, F.date_add(F.to_date(lit(origin)), F.floor(n).cast("int")))
    shift, part = EPOCHS[origin]
    day = F.floor((n / 86400 if origin == "spss" else n) + part)
    if origin == "excel":
        good, day = good & (day != 60), F.when(day < 60, day + 1).otherwise(day)
    return F.when(good, F.date_add(F.to_date(lit("1970-01-01")), (day + shift).cast("int")))


_TIME = r"\d\d:\d\d:\d\d(?:\.\d+)?"
_STAMPS = {
    "iso": rf"\A\d{{4}}-\d\d-\d\d {_TIME}\z", "compact": r"\A\d{14}\z",
    "rfc3339": rf"\A\d{{4}}-\d\d-\d\d[Tt ]{_TIME}(?:[Zz]|[+-]\d\d:\d\d)\z", "iso_offset": rf"\A\d{{4}}-\d\d-\d\d[Tt ]{_TIME}(?:[Zz]|[+-]\d\d:\d\d)\z",
}


def fas_timestamp(x: ColumnLike, format: str = "iso") -> Column:  # noqa: A002
    """Texts as instants; texts without an offset are in UTC."""
    y = col(x)
    cut = (lambda a, n: F.substring(y, a, n)) if format == "compact" else None
    if cut:
        date, clock = F.concat_ws("-", cut(1, 4), cut(5, 2), cut(7, 2)), F.concat_ws(":", cut(9, 2), cut(11, 2), cut(13, 2))
    else:
        date, clock = F.substring(y, 1, 10), F.regexp_extract(y, _TIME, 0)
    hour, minute, second = F.substring(clock, 1, 2), F.substring(clock, 4, 2), F.substring(clock, 7, 2)
    offset = F.regexp_extract(y, r"([+-]\d\d):(\d\d)\z", 0)
    sign = F.when(F.startswith(offset, lit("-")), -1).otherwise(1)
    away = F.when(offset == "", 0).otherwise(sign * (F.substring(offset, 2, 2).try_cast("int") * 3600 + F.substring(offset, 5, 2).try_cast("int") * 60))
    part = F.when(F.contains(clock, lit(".")), F.concat(lit("0."), F.regexp_extract(clock, r"\.(\d+)", 1)).try_cast("double")).otherwise(0.0)
    day = F.when(date.rlike(r"\A\d{4}-\d\d-\d\d\z"), F.try_to_date(date, "yyyy-MM-dd"))
    seconds = F.datediff(day, F.to_date(lit("1970-01-01"))).cast("long") * 86400 + hour.try_cast("long") * 3600 + minute.try_cast("long") * 60 + second.try_cast("long")
    good = y.rlike(_STAMPS[format]) & (hour < "24") & (minute < "60") & (second < "60") & (F.abs(away) < 86400)
    return F.when(good, F.timestamp_micros((seconds - away) * 1000000 + F.round(part * 1000000).cast("long")))


def format_date(x: ColumnLike, format: str = "iso") -> Column:  # noqa: A002
    return F.date_format(col(x).cast("date"), LAYOUTS[format][1])


def format_datetime(x: ColumnLike, format: str = "iso", offset: str = "Z") -> Column:  # noqa: A002
    """An instant in UTC, or, in iso_offset, at a fixed offset like +10:00."""
    minutes = 0 if offset == "Z" else int(offset[0] + "1") * (int(offset[1:3]) * 60 + int(offset[4:6]))
    if minutes and format != "iso_offset":
        raise ValueError("only iso_offset has an offset")
    micros = F.unix_micros(col(x).cast("timestamp")) + minutes * 60_000_000
    second = F.floor(micros / 1_000_000)
    day = F.date_add(F.to_date(lit("1970-01-01")), F.floor(second / 86400).cast("int"))
    left = F.pmod(second, lit(86400)).cast("int")
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    clock = [two(F.floor(left / 3600)), two(F.floor(left % 3600 / 60)), two(left % 60)]
    if format == "compact":
        return F.concat(F.date_format(day, "yyyyMMdd"), *clock)
    written = F.concat(F.date_format(day, "yyyy-MM-dd"), lit(" " if format == "iso" else "T"), F.concat_ws(":", *clock))
    return written if format == "iso" else F.concat(written, lit("Z" if format == "rfc3339" or offset == "Z" else offset))


def date_parts(x: ColumnLike) -> Column:
    """year, month and day."""
    d = col(x).cast("date")
    return F.when(d.isNotNull(), F.struct(F.year(d).alias("year"), F.month(d).alias("month"), F.day(d).alias("day")))


def format_date_parts(year: Column | int = 1970, month: Column | int = 1, day: Column | int = 1, format: str = "iso") -> Column:  # noqa: A002
    """Numbers as text in a layout, without a look at the calendar; numbers too wide give null."""
    given = {k: v if isinstance(v, Column) else lit(v) for k, v in (("y", year), ("m", month), ("d", day))}
    most = {"y": 9999, "m": 99, "d": 99}
    text = {k: F.lpad(v.cast("string"), 4 if k == "y" else 2, "0") for k, v in given.items()}
    fields, sep = LAYOUTS[format][2], {"compact": "", "dmy": "/", "ymd_slash": "/"}.get(format, "-")
    good = lit(True)
    for f in fields:
        good = good & given[f].between(0, most[f])
    return F.when(good, F.concat_ws(sep, *[text[f] for f in fields]))

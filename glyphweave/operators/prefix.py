"""Running sums over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

from glyphweave.workdir import Work


#: Rows that one range holds, about, and ranges at most.
RANGE, RANGES = 200_000, 64


def with_running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, in_range: int = RANGE) -> DataFrame:
    """``df`` with running sums (new name -> summed column) in the order of a column whose values differ.

    The table is written once. Values are dealt to ranges of about ``in_range`` rows, ``RANGES`` at most, by
    boundaries from a bounded sample. Sums within a range and the sums of the ranges before it, a
    table of that many rows, make the whole.
    """
    held = Work(df.sparkSession, "running").write(df, "rows")
    blocks = min(RANGES, -(-held.count() // in_range))
    way = F.desc if descending else F.asc
    within = Window.partitionBy("__block").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    if blocks <= 1:
        return held.withColumn("__block", lit(0)).select(*df.columns, *[F.sum(c).over(within).alias(n) for n, c in sums.items()])
    sample = held.select(order).orderBy(F.xxhash64(order)).limit(50 * blocks)
    block = lit(0)
    for i, cut in enumerate([r[0] for r in sample.orderBy(order).collect()][::50], 1):
        block = F.when(F.col(order) >= (F.struct(*map(lit, cut)) if isinstance(cut, Row) else lit(cut)), i).otherwise(block)
    held = held.withColumn("__block", block)
    totals = held.groupBy("__block").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.orderBy(way("__block")).rowsBetween(Window.unboundedPreceding, -1)  # at most blocks + 1 rows
    totals = totals.select("__block", *[F.coalesce(F.sum(f"__{n}").over(before), lit(0)).alias(f"__{n}") for n in sums])
    out = held.select("*", *[F.sum(c).over(within).alias(f"__own_{n}") for n, c in sums.items()]).join(F.broadcast(totals), "__block")
    return out.select(*df.columns, *[(F.col(f"__own_{n}") + F.col(f"__{n}")).alias(n) for n in sums])

"""Blocking of a stream of records against a table or against another stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

from glyphweave.functions.udf import ColumnLike
from glyphweave.operators.blocking import Key, key_of

def stream_block(stream: DataFrame, keys: Sequence[ColumnLike], table: DataFrame, table_keys: Sequence[ColumnLike]) -> DataFrame:
    """A stream of records joined with a table on agreeing keys; everything after works as on a table."""
    on = lit(True)
    for a, b in zip(keys, table_keys, strict=True):
        on = on & (stream[a] == table[b] if isinstance(a, str) and isinstance(b, str) else a == b)
    return stream.join(table, on)


def stream_pairs(x: DataFrame, key: Key, id_x: str, time_x: str, y: DataFrame, key_y: Key, id_y: str, time_y: str, within: str) -> DataFrame:
    """Pairs of two streams that agree on a key and come within an interval of each other: x_id, y_id, x_time, y_time.

    Both sides get a watermark of the interval, so the state holds what may still find a partner and no more.
    """
    a = x.withWatermark(time_x, within).select(F.col(id_x).alias("x_id"), F.col(time_x).alias("x_time"), key_of(key).alias("x_key"))
    b = y.withWatermark(time_y, within).select(F.col(id_y).alias("y_id"), F.col(time_y).alias("y_time"), key_of(key_y).alias("y_key"))
    near = F.expr(f"y_time between x_time - interval {within} and x_time + interval {within}")
    return a.join(b, (F.col("x_key") == F.col("y_key")) & near).select("x_id", "y_id", "x_time", "y_time")

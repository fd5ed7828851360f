"""Arrow functions around kernels that Column expressions cannot express."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

ColumnLike = Column | str


def col(x: ColumnLike) -> Column:
    """A column, by itself or by name."""
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is computed once, however often ``made`` names it: a column named twice is an expression written twice."""
    return F.transform(F.array(x), made)[0]


#: Results that are held for values that come again in a later batch.
HELD = 1 << 16
_RESULTS: dict[str, dict] = {}


def results(name: str) -> dict:
    """What this process holds of a function's results, for its later tasks too; beyond ``HELD`` of all functions nothing is kept."""
    if sum(map(len, _RESULTS.values())) > HELD:
        _RESULTS.clear()
    return _RESULTS.setdefault(name, {})


def _arrow(kind: str) -> tuple[Any, pa.DataType]:
    parsed = _parse_datatype_string(kind)
    return parsed, to_arrow_type(parsed)


def each(kind: str, kernel: Callable, *fixed: Any) -> Callable[..., Column]:
    """A function of columns: ``kernel(value, ..., *fixed)`` once for each different row of values of a batch, mostly of a task (of several columns: of a process); null in any gives null."""
    parsed, arrow = _arrow(kind)
    seen, name = {}, uuid4().hex

    @arrow_udf(parsed)
    def run(*columns: pa.Array) -> pa.Array:
        if len(columns) > 1:
            held, places = results(name), {}
            at = [places.setdefault(row, len(places)) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
            for row in places:
                if row not in held:
                    held[row] = None if None in row else kernel(*row, *fixed)
            return pa.array([held[row] for row in places], arrow).take(pa.array(at, pa.int32()))
        if len(seen) > HELD:
            seen.clear()
        out = []
        for v in columns[0].to_pylist():
            if v is None:
                out.append(None)
                continue
            if v not in seen:
                seen[v] = kernel(v, *fixed)
            out.append(seen[v])
        return pa.array(out, arrow)

    return run


def pairs(kind: str, kernel: Callable, *fixed: Any) -> Callable[[ColumnLike, ColumnLike], Column]:
    """A function of two string columns: ``kernel(list, list, *fixed)`` over the different pairs of a batch that this process has not had; null in either gives null."""
    parsed, arrow = _arrow(kind)
    name = uuid4().hex

    @arrow_udf(parsed)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        seen = results(name)
        rows = [None if x is None or y is None else (x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        new = list({r: None for r in rows if r is not None and r not in seen})
        if new:
            found = kernel([x for x, _ in new], [y for _, y in new], *fixed)
            seen.update(zip(new, found.tolist() if hasattr(found, "tolist") else found, strict=True))
        return pa.array([None if r is None else seen[r] for r in rows], arrow)

    return lambda x, y: run(col(x), col(y))

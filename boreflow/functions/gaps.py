"""Linear interpolation of one series at a time, as a grouped Arrow aggregate that gives its rows back.

A grouped aggregate keeps the partitioning by series, which a scalar UDF over arrays loses: what follows
by series needs no further exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_order(parts: Sequence[pa.Array]) -> list[pa.Array]:
    """The rows of a series sorted by the first column, nulls first."""
    order = parts[0]
    if pa.types.is_date32(order.type):
        order = order.cast(pa.int32())
    elif pa.types.is_timestamp(order.type):
        order = order.cast(pa.int64())
    if order.null_count == 0 and (pa.types.is_integer(order.type)):
        at = order.to_numpy()
        if (at[1:] >= at[:-1]).all():
            return list(parts)
    by = pc.array_sort_indices(order, order="ascending", null_placement="at_start")
    return [p.take(by) for p in parts]


def known_of(part: pa.Array) -> np.ndarray | None:
    """Which values are not null; None if all are."""
    return None if part.null_count == 0 else part.is_valid().to_numpy(zero_copy_only=False)


def values_of(part: pa.Array) -> np.ndarray:
    """The values as doubles, 0 for null."""
    return np.asarray((part.fill_null(0) if part.null_count else part).to_numpy(zero_copy_only=False), float)


def fill_gaps(v: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Values with the gaps filled by row position; at least one is known.

    Interior gaps: ``prev + (next - prev) * (pos - pos_prev) / (pos_next - pos_prev)``; leading gaps take
    the first value, trailing gaps the last one.
    """
    at, gaps = np.flatnonzero(known), np.flatnonzero(~known)
    place = np.searchsorted(at, gaps)
    before, after = at[np.maximum(place - 1, 0)], at[np.minimum(place, len(at) - 1)]
    a, b = v[before], v[after]
    with np.errstate(all="ignore"):
        between = a + (b - a) * (gaps - before).astype(float) / (after - before).astype(float)
    out = v.copy()
    out[gaps] = np.where(place == 0, b, np.where(place == len(at), a, between))
    return out


def plain(part: pa.Array):
    """A column as NumPy numbers, which pass to Arrow as one block (days and microseconds of dates and times); others as a list."""
    if part.null_count:
        return part.to_pylist()
    if pa.types.is_date32(part.type):
        part = part.cast(pa.int32())
    elif pa.types.is_timestamp(part.type):
        part = part.cast(pa.int64())
    return part.to_numpy() if pa.types.is_floating(part.type) or pa.types.is_integer(part.type) else part.to_pylist()


def fill(row: T.StructType, cols: Sequence[str], *fields: Column) -> Column:
    """Aggregate ``struct`` of one array per field of ``row``: the series in order, the gaps of ``cols`` filled.

    The first field is the order.
    """
    wanted, names = frozenset(cols), row.names

    def run(*parts):
        out = {}
        for name, part in zip(names, in_order(parts), strict=True):
            known = known_of(part) if name in wanted else None
            out[name] = fill_gaps(values_of(part), known) if known is not None and known.any() else plain(part)
        return out

    arrays = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in row.fields])
    return F.arrow_udf(run, arrays, F.ArrowUDFType.GROUPED_AGG)(*fields)

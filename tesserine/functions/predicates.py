"""Field predicates as Columns.

A row without the field fails every predicate. ``ne`` is "not comparable and
equal": a NULL or incomparable value passes it. Booleans and bytes never compare
equal to anything; numbers compare as DOUBLE; text compares bytewise.
"""

from __future__ import annotations

import math
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains")


def _comparable(dtype: T.DataType, value: object) -> bool:
    if isinstance(value, bool) or isinstance(dtype, (T.BooleanType, T.BinaryType)):
        return False
    if isinstance(value, (int, float)):
        return isinstance(dtype, (T.NumericType, T.TimestampType, T.TimestampNTZType))
    return isinstance(value, str) and isinstance(dtype, T.StringType)


def _literal(dtype: T.DataType, value: object) -> Column | None:
    """The value in the column's own type, if comparing in that type is comparing as DOUBLE; such a test reaches the scan."""
    if isinstance(value, str):
        return F.lit(value)
    if isinstance(dtype, T.DoubleType):
        return F.lit(float(value))
    bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 53}.get(type(dtype))
    if bits and float(value).is_integer() and abs(value) < 1 << bits:
        return F.lit(int(value)).cast(dtype)
    return None


def _test(df: DataFrame, field: str, op: str, value: object) -> Column:
    """One predicate as a filter takes it: NULL and false are the same."""
    if op not in OPS:
        raise ValueError(f"unknown predicate {op}")
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("predicate values must be finite")
    if field not in df.columns:
        return F.lit(False)
    dtype, col = df.schema[field].dataType, df[field]
    if op == "contains":
        if isinstance(dtype, T.StringType):
            return col.contains(value)
        if isinstance(dtype, T.BinaryType):
            return F.position(F.hex(F.lit(value)), F.hex(col)) > 0
        return F.lit(False)
    if not _comparable(dtype, value):
        return F.lit(op == "ne")
    left, right = col, _literal(dtype, value)
    if right is None:
        left, right = col.cast("double"), F.lit(float(value))
    if op == "ne":
        return (left != right) | col.isNull()
    return {"eq": left == right, "gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]


def field_predicate(df: DataFrame, field: str, op: str, value: object) -> Column:
    """One predicate; never NULL, so that it can be negated."""
    return F.coalesce(_test(df, field, op, value), F.lit(False))


def where_all(df: DataFrame, predicates: list[tuple[str, str, object]]) -> DataFrame:
    """Rows that pass all predicates; tests on bare columns, which the scan prunes by."""
    return df.where(reduce(lambda a, b: a & b, (_test(df, *p) for p in predicates), F.lit(True)))


def live(now: int, expires_at: str = "expires_at") -> Column:
    """Key-value rows that have not expired: 0 never expires, and an entry is gone at its own expiry."""
    return ~((F.col(expires_at) != 0) & (F.lit(now) >= F.col(expires_at)))


def json_path(doc: str, path: list[str], value: str | None = None) -> Column:
    """A document has a subtree at a path, equal to ``value`` where that is given. Keys may hold dots, but no quotes."""
    if any("'" in k for k in path):
        raise ValueError("keys must not hold quotes")
    got = F.get_json_object(F.col(doc), "$" + "".join(f"['{k}']" for k in path))
    return F.coalesce(got.isNotNull() if value is None else got == F.lit(value), F.lit(False))


def in_window(ts: str, start: int, end: int) -> Column:
    """Event time (epoch seconds) in [start, end]."""
    return F.col(ts).between(start, end)


def in_seconds(df: DataFrame, ts: str, start: int, end: int) -> Column:
    """A timestamp whose whole epoch second lies in [start, end], as bounds on the bare column."""
    dtype = df.schema[ts].dataType
    at = [datetime.fromtimestamp(x, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") for x in (start, end + 1)]
    zone = "" if isinstance(dtype, T.TimestampNTZType) else "+00:00"
    low, high = (F.lit(x + zone).cast(dtype) for x in at)
    return (F.col(ts) >= low) & (F.col(ts) < high)

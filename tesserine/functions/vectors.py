"""Vector expressions in DOUBLE over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NULL for a zero norm or different lengths."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def slot(vec: Column, number: int, width: int) -> Column:
    """Sub-vector ``number`` (0-based) of equal parts."""
    return F.slice(vec, number * width + 1, width)


def sign_code(vec: Column) -> Column:
    """Binary quantisation: one bit per component of at most 63."""
    return F.aggregate(vec, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1) + F.when(x > 0, 1).otherwise(0))


def int8_max_abs(vec: Column) -> Column:
    """Components scaled to -127..127 by the largest magnitude; zero vectors stay zero."""
    top = F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))
    return F.transform(vec, lambda x: F.coalesce(F.round(F.try_divide(x.cast("double") * 127, top)), F.lit(0.0)).cast("int"))


def normalised(a: Column) -> Column:
    """Unit length; NULL for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def delta(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def interaction(a: Column, b: Column) -> Column:
    """Products of components."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def sign_bits(vec: Column) -> Column:
    """Binary quantisation of any length: an array of 32-bit words as longs."""
    words = F.transform(F.sequence(F.lit(0), F.floor((F.size(vec) - 1) / 32).cast("int")), lambda w: F.slice(vec, w * 32 + 1, 32))
    return F.transform(words, sign_code)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two sign codes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("long"), lambda s, x: s + x)

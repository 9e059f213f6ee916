"""Vector arithmetic as column expressions, all in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Divide by max(norm, 1e-12): a zero vector stays zero."""
    return _scaled(v, F.greatest(norm(v), F.lit(TINY)))


def l2_normalize_guarded(v: Column) -> Column:
    """Divide by the norm if it exceeds 1e-12, else leave the vector as it is."""
    return F.when(norm(v) > TINY, _scaled(v, norm(v))).otherwise(v)


def _scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x / by)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero: a NaN would sort above every similarity."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def has_dimension(v: Column, dimension: int) -> Column:
    """False for a null vector or one of another length."""
    return F.coalesce(F.size(v) == dimension, F.lit(False)) & v.isNotNull()


def require_dimension(v: Column, dimension: int) -> Column:
    """The vector itself; raises for a null vector or one of another length."""
    return F.when(has_dimension(v, dimension), v).otherwise(F.raise_error(F.lit(f"a vector of {dimension} numbers is needed")).cast("array<double>"))

"""Dense vectors as arrays of doubles, without UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row: an expression inside of a lambda is computed for every element."""
    return F.transform(F.array(value), body)[0]


def unit(a: Column) -> Column:
    """Divided by the norm; a zero vector stays as it is."""
    return once(a, lambda v: once(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is missing or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def outer(a: Column, b: Column) -> Column:
    """Row-major outer product, flattened."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def as_doubles(a: Column) -> Column:
    return a.cast("array<double>")


def sum_vectors(rows: DataFrame, keys: list[str], vector: str, out: str) -> DataFrame:
    """Element-wise sum per key: positions are exploded and summed map-side first, so a hot key costs one row per task and position."""
    long = rows.select(*keys, F.posexplode(vector).alias("i", "x"))
    sums = long.groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return sums.groupBy(*keys).agg(ordered.alias(out))

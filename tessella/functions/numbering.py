"""Dense numbers for rows in the order of a numeric key, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Borders between buckets are looked up in two steps of so many.
STEP = 32


def bucket_of(rows: DataFrame, key: str, buckets: int = STEP * STEP) -> Column:
    """The bucket of ``key``, ascending with it. Borders are approximate quantiles, a fixed number of values, so that
    buckets are about even wherever the keys lie; which row is in which bucket never changes a result."""
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    found = rows.agg(F.percentile_approx(key, shares, F.lit(4 * buckets))).first()[0] or []
    borders = sorted({int(b) for b in found})
    if not borders:
        return F.lit(0)
    blocks = [borders[i : i + STEP] for i in range(0, len(borders), STEP)]
    low = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
    inner = F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in blocks])
    block = F.size(F.filter(low, lambda b: b <= F.col(key)))
    return F.when(block == 0, 0).otherwise((block - 1) * STEP + F.size(F.filter(F.element_at(inner, F.greatest(block, F.lit(1))), lambda b: b <= F.col(key)))).cast("int")


def _offsets(placed: DataFrame, amount: Column) -> DataFrame:
    # a table of bucket sums, whose size is fixed
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return placed.groupBy("bucket").agg(amount.alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def dense_index(rows: DataFrame, key: str, out: str, buckets: int = STEP * STEP, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``out``: 0, 1, … by ``key`` (then ``ties``). Rows are counted in buckets of the key, offsets come from the counts."""
    placed = rows.withColumn("bucket", bucket_of(rows, key, buckets))
    inside = Window.partitionBy("bucket").orderBy(key, *ties)
    return placed.join(_offsets(placed, F.count("*")), "bucket").withColumn(out, F.col("offset") + F.row_number().over(inside) - 1).drop("bucket", "offset")


def running_total(rows: DataFrame, key: str, value: str, out: str, buckets: int = STEP * STEP) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows with a smaller key. Keys are unique; two levels, like ``dense_index``."""
    placed = rows.withColumn("bucket", bucket_of(rows, key, buckets))
    inside = F.sum(value).over(Window.partitionBy("bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(_offsets(placed, F.sum(value)), "bucket").withColumn(out, F.col("offset") + F.coalesce(inside, F.lit(0))).drop("bucket", "offset")

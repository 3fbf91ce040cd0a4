"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

All of it is DataFrame functions. Rows get dense global numbers from two-level counts (hash buckets of the row,
then the order inside a bucket), a keyed Feistel network permutes the numbers, and shard and slot follow by arithmetic.
The network mixes Z_a x Z_b with a * b just above the row count, so walking out of the surplus takes a step or two.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, parts


def feistel(x: Column, a: int, b: int, seed: int, rounds: int = 6) -> Column:
    """A keyed permutation of 0 .. a*b-1: halves in Z_a and Z_b, alternately shifted by a hash of the other."""

    def mixed(pair: Column, r: int) -> Column:
        left, right = pair["l"], pair["r"]
        if r % 2:
            return F.struct(left.alias("l"), F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), left), F.lit(b)), F.lit(b)).alias("r"))
        return F.struct(F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), right), F.lit(a)), F.lit(a)).alias("l"), right.alias("r"))

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    end = F.aggregate(
        F.array(*[F.lit(r) for r in range(rounds)]),
        start,
        lambda pair, r: _chosen(pair, r, rounds, mixed),
    )
    return end["l"] * F.lit(b) + end["r"]


def _chosen(pair: Column, r: Column, rounds: int, mixed) -> Column:
    out = mixed(pair, rounds - 1)
    for k in range(rounds - 2, -1, -1):
        out = F.when(r == k, mixed(pair, k)).otherwise(out)
    return out


def permuted(x: Column, n: int, seed: int, steps: int = 64) -> Column:
    """The position of row number ``x`` among ``n``: the Feistel image, walked along its cycle until it is below ``n``.

    At most ``a * b - n`` images lie above ``n``; where that is more than ``steps``, a walk of ``steps`` has a chance
    below 1e-70 and raises instead of giving a wrong position.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    first = feistel(x, a, b, seed)
    if a * b == n:
        return first
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(min(steps, a * b - n + 1))),
        first,
        lambda y, _: F.when(y < n, y).otherwise(feistel(y, a, b, seed)),
    )
    y = F.when(first < n, first).otherwise(walk)
    return F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def numbered(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Adds ``row_no``, dense from 0 and fixed by the values of ``keys``, all columns of ``rows``, alone, and gives the row count.

    Buckets are hashes of the keys; a table of bucket counts, of a size fixed by the shuffle width, carries the offsets.
    Rows that repeat all keys are interchangeable; they are counted as one and spread out at the end.
    """
    spark = rows.sparkSession
    buckets = 16 * parts(spark)
    unique = durable(rows.groupBy(*keys).agg(F.count("*").alias("same")).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    counts = unique.groupBy("bucket").agg(F.sum("same").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket").orderBy(*[F.col(k).asc_nulls_last() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum("same").over(inside), F.lit(0))
    placed = unique.join(offsets, "bucket").withColumn("first", first)
    out = placed.withColumn("row_no", F.explode(F.sequence("first", F.col("first") + F.col("same") - 1)))
    return out.select(*keys, "row_no"), int(unique.agg(F.coalesce(F.sum("same"), F.lit(0))).first()[0])


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20_011, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard and slot under law ``rows``: shard counts differ by at most one, slots have no gaps.

    Columns: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard (always null: the
    law fixes nothing for another shard count). Null text has no bytes. Repeated rows each get their own slot, null
    identifiers too; an empty table gives no rows; other columns are ignored. The text itself is never shuffled.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    thin = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows, n = numbered(thin, ["doc_id", "text_crc32", "size"])
    at = permuted(F.col("row_no"), n, seed)
    return rows.withColumn("at", at).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("at", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("at") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

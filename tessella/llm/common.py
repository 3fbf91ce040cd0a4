"""Shared plumbing of the training-data operators: sessions, durable tables, connected components."""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, ensure_checkpoint_dir

#: The ASCII white space that separates words everywhere in this subpackage (bytes.split() uses the same set).
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Shuffle width of the session: the cluster's owner sizes it, operators follow it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Frames made inside give up their shuffle files when an action on them ends, not when the driver collects its garbage.

    For steps that each end in ``durable``, which doesn't need them again; a frame run twice would shuffle twice.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextlib.contextmanager
def stored(df: DataFrame, buckets: int, key: str) -> Iterator[DataFrame]:
    """``df`` as a table bucketed by ``key`` in the checkpoint folder, so that groupings by it don't shuffle it again; gone afterwards."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"tessella_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def crc32_text(col: Column) -> Column:
    """CRC-32 of a value's decimal text; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")))


def row_tag(doc_id: Column, text: Column) -> Column:
    """64 bits that stand for a row's identifier and text; a null identifier or text is told from any other."""
    return F.xxhash64(doc_id, doc_id.isNull(), text, text.isNull())


def smallest_hashes(rows: DataFrame, h: str, sizes: dict, n: int, by: str | None = None) -> DataFrame:
    """The rows of each group ``by`` whose hash ``h`` (signed, 64 bits) is among about the ``n`` smallest, by a threshold.

    ``sizes`` gives the groups' rows. The threshold leaves as many rows as are wanted and six standard deviations more,
    so that nothing has to be ranked; groups of ``n`` rows or fewer stay whole.
    """
    wanted = n + 6 * math.sqrt(n) + 20
    limits = [(k, (1 << 63) - 1 if size <= wanted else int(wanted / size * (1 << 64)) - (1 << 63)) for k, size in sizes.items()]
    if by is None:
        return rows.where(F.col(h) <= F.lit(limits[0][1]))
    key = rows.schema[by].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(limits, f"grp {key}, most long")
    # one row a group
    return rows.join(F.broadcast(table), (F.col(by) == F.col("grp")) & (F.col(h) <= F.col("most"))).drop("grp", "most")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node, root being the smallest node id reachable.

    Alternating large-star and small-star contraction: both are one min-aggregation by node and one join back, so a
    hub costs a partial aggregate and a join side that adaptive execution may split; the depth is logarithmic.
    Every round is checkpointed. Self-loops and repeated edges are ignored; no edges give no rows.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # each node's smallest neighbour, itself included
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = pairs.join(low, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))

    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        after_large = star(both, True).where("u <> v").distinct()
        oriented = after_large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = durable(star(oriented, False).where("u <> v").distinct())
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

"""Counts, vocabularies, pruning and sparse matrices in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import dense_index

UNKNOWN = "<unk>"


def pair_counts(pairs: DataFrame) -> DataFrame:
    """How often each (src, tgt) occurs; the long form also serves for counts by target."""
    return pairs.groupBy("src", "tgt").agg(F.count("*").alias("n"))


def _ranked(counts: DataFrame) -> DataFrame:
    best = Window.partitionBy("src").orderBy(F.desc("n"), "tgt")
    return counts.withColumn("rn", F.row_number().over(best))


def top_targets(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent targets of each source; ties go to the target that sorts first."""
    return _ranked(counts).where(F.col("rn") <= k).drop("rn")


def excluded_pairs(counts: DataFrame, k: int) -> DataFrame:
    """What ``top_targets`` leaves out: ranks up to ``k`` are pruned below the shuffle, ranks beyond it are never computed."""
    return counts.join(top_targets(counts, k).select("src", "tgt"), ["src", "tgt"], "left_anti")


def vocabulary(occurrences: DataFrame, cutoff: int, type_col: str, pos_col: str, first_id: int = 0, then: tuple[str, ...] = ()) -> DataFrame:
    """(type, id) of types that occur more than ``cutoff`` times, numbered by the place of occurrence number cutoff + 1.

    Places are ordered by ``pos_col``, a number, and ``then``.

    The rank filter is pushed below the shuffle, so a word that makes up a third of the corpus sends a few rows per task.
    """
    turn = Window.partitionBy(type_col).orderBy(pos_col, *then)
    reached = occurrences.select(type_col, pos_col, *then).withColumn("rn", F.row_number().over(turn)).where(F.col("rn") == cutoff + 1).drop("rn")
    return dense_index(reached, pos_col, "id", ties=then).select(F.col(type_col).alias("type"), (F.col("id") + first_id).cast("long").alias("id"))


def pair_vocabulary(rows: DataFrame, cutoff: int, excluded: DataFrame | None = None, unknown: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vocabulary of ``src ||| tgt`` and the rows' column ids.

    With ``unknown`` column 0 is the unknown pair, which rare and excluded rows fall into; without it they have no entry.
    """
    keyed = rows.select("row_id", F.concat_ws(" ||| ", "src", "tgt").alias("type"), "src", "tgt")
    allowed = keyed if excluded is None else keyed.join(excluded.select("src", "tgt"), ["src", "tgt"], "left_anti")
    vocab = vocabulary(allowed, cutoff, "type", "row_id", int(unknown))
    kept = vocab if not unknown else vocab.unionByName(rows.sparkSession.createDataFrame([(f"{UNKNOWN} ||| {UNKNOWN}", 0)], "type string, id long"))
    ids = keyed.select("row_id", "type").join(vocab, "type", "left" if unknown else "inner")
    return kept, ids.select("row_id", F.coalesce("id", F.lit(0)).cast("long").alias("id"))


def context_vocabulary(features: DataFrame, cutoff: int) -> DataFrame:
    """Vocabulary of context features; they are placed by row, left side before right, and position."""
    return vocabulary(features, cutoff, "feature", "row_id", then=("side", "pos"))


def distance_of(feature: Column) -> Column:
    """``_dist{k}`` of a decorated feature, empty for boundaries and plain words."""
    return F.regexp_extract(feature, r"(_dist\d+)$", 1)


def context_matrix(features: DataFrame, cutoff: int, position: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vocabulary of context features and the sparse matrix (row_id, id, val); occurrences of a feature in a row add up.

    Features at or under ``cutoff`` fall into ``<unk>``, with ``position`` into one such column for each distance. Those
    columns exist only if some feature falls into them; boundaries that are rare have one without a distance.
    """
    vocab = context_vocabulary(features, cutoff)
    rare = F.concat(F.lit(UNKNOWN), distance_of(F.col("feature"))) if position else F.lit(UNKNOWN)
    known = features.join(vocab.select(F.col("type").alias("feature"), F.col("id").alias("own")), "feature", "left").withColumn("name", F.when(F.col("own").isNull(), rare))
    # one column, or one for each distance and the boundaries
    unknown = known.where("own is null").select("name").distinct()
    top = vocab.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("first"))
    turn = F.row_number().over(Window.orderBy("name")) - 1
    extra = unknown.withColumn("turn", turn).join(F.broadcast(top)).select(F.col("name").alias("type"), (F.col("first") + F.col("turn")).cast("long").alias("id"))
    placed = known.join(F.broadcast(extra.select(F.col("type").alias("name"), F.col("id").alias("spare"))), "name", "left").select("row_id", F.coalesce("own", "spare").alias("id"))
    return vocab.unionByName(extra), placed.groupBy("row_id", "id").agg(F.count("*").cast("double").alias("val"))


def summed_cells(cells: DataFrame) -> DataFrame:
    """Repeated (row_id, id) entries add up."""
    return cells.groupBy("row_id", "id").agg(F.sum("val").alias("val"))


def column_sums(cells: DataFrame) -> DataFrame:
    return cells.groupBy("id").agg(F.sum("val").alias("total"))


def centred(vectors: DataFrame, key: str) -> DataFrame:
    """Long form (key, i, x) of dense vectors with each dimension's mean taken off; the means are one row per dimension."""
    long = vectors.select(key, F.posexplode("v").alias("i", "x"))
    means = long.groupBy("i").agg(F.avg("x").alias("mean"))
    return long.join(F.broadcast(means), "i").select(key, "i", (F.col("x") - F.col("mean")).alias("x"))


def without_empty_rows(cells: DataFrame, others: DataFrame) -> DataFrame:
    """Entries of rows that both matrices fill, renumbered densely by row."""
    both = cells.select("row_id").distinct().join(others.select("row_id").distinct(), "row_id", "left_semi")
    return cells.join(dense_index(both, "row_id", "new_row"), "row_id")


def row_subset(cells: DataFrame, rows: DataFrame) -> DataFrame:
    return cells.join(rows.select("row_id"), "row_id", "left_semi")


def held_out(rows: DataFrame, fraction: float, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Exactly ``int(fraction * n)`` rows, those whose key and seed have the smallest MD5; the same ones in every run.

    The border is found from counts per hash bucket, so no row set is sorted as a whole.
    """
    n = rows.count()
    take = int(fraction * n)
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    placed = rows.withColumn("h", h).withColumn("bucket", F.substring("h", 1, 3))
    # 4,096 buckets at most
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).where(F.col("offset") < take)
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("bucket").orderBy("h", key))
    return placed.join(F.broadcast(offsets), "bucket").withColumn("rank", rank).where(F.col("rank") <= take).drop("h", "bucket", "offset", "rank")


def sign_means(vectors: DataFrame) -> DataFrame:
    """Per dimension the mean of the positive and of the negative values; 0 where there are none."""
    long = vectors.select(F.posexplode("v").alias("i", "x"))
    mean = lambda test: F.coalesce(F.avg(F.when(test, F.col("x"))), F.lit(0.0))
    return long.groupBy("i").agg(mean(F.col("x") > 0).alias("pos_mean"), mean(F.col("x") < 0).alias("neg_mean"))


def sign_buckets(vectors: DataFrame, means: DataFrame, key: str) -> DataFrame:
    """1 where a positive value is above the positive mean, or another below the negative mean; else 0."""
    long = vectors.select(key, F.posexplode("v").alias("i", "x"))
    on = F.when(F.col("x") > 0, F.col("x") > F.col("pos_mean")).otherwise(F.col("x") < F.col("neg_mean"))
    return long.join(F.broadcast(means), "i").select(key, "i", on.cast("int").alias("bucket"))

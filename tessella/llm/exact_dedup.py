"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition sorts its (digest, doc_id) pairs into one run. Partitions then exchange runs in rounds: in round
``k`` the partitions whose numbers differ only in their ``k``-th digit trade the slices that carry the other digits of
the digest, and each merges what it gets (binomial for radix 2, multiway above). After the last round a partition holds
one slice of the digest space completely, so no task ever sees more than its slice. Each merge keeps the smallest
identifier and the member count of a digest, and verifies that equal digests stand for texts of equal length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, durable, parts, row_tag
from .resemblance import may_be_among



def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest_columns(text: Column) -> list[Column]:
    norm = normalised(text)
    return [F.unhex(F.sha2(norm, 256)).alias("digest"), F.octet_length(norm).cast("long").alias("n_bytes")]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapses rows sorted by (digest, keep_id): the first identifier of a digest stays, counts add up."""
    held: pa.Table | None = None

    def collapsed(t: pa.Table) -> pa.Table:
        d = t["digest"].combine_chunks()
        new = np.ones(len(d), bool)
        if len(d) > 1:
            new[1:] = pc.not_equal(d.slice(1), d.slice(0, len(d) - 1)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new)
        size = t["n_bytes"].to_numpy()
        if not np.array_equal(size, size[at][np.cumsum(new) - 1]):
            raise ValueError("equal digests of texts that differ")
        out = t.take(pa.array(at))
        column = out.schema.get_field_index("n")
        return out.set_column(column, out.schema.field(column), pa.array(np.add.reduceat(t["n"].to_numpy(), at), pa.int64()))

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = collapsed(t if held is None else pa.concat_tables([held, t]).combine_chunks())
        held = t.slice(t.num_rows - 1)
        yield from t.slice(0, t.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def merge_runs(digests: DataFrame) -> DataFrame:
    """``digests(digest, doc_id, n_bytes)`` to one row per digest: digest, keep_id (smallest doc_id; null if all are null), n."""
    spark = digests.sparkSession
    width = parts(spark)
    rounds = 1 if width <= 4 else 2 if width <= 1024 else 3
    radix = max(2, math.ceil(width ** (1 / rounds)))
    leaves = radix**rounds
    order = ["digest", F.col("keep_id").asc_nulls_last()]
    run = f"digest binary, keep_id {digests.schema['doc_id'].dataType.simpleString()}, n_bytes long, n long, slot int"
    word = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    runs = (
        digests.select("digest", F.col("doc_id").alias("keep_id"), "n_bytes", F.lit(1).cast("long").alias("n"), (F.spark_partition_id() % leaves).alias("slot"))
        .sortWithinPartitions(*order)
        .mapInArrow(_merge, run)
    )
    for k in range(rounds):
        unit = radix**k
        theirs = (F.floor(word / unit) % radix).cast("int")
        mine = (F.floor(F.col("slot") / unit) % radix).cast("int")
        moved = (F.col("slot") + (theirs - mine) * unit).cast("int")
        runs = runs.withColumn("slot", moved).repartitionById(leaves, "slot").sortWithinPartitions(*order).mapInArrow(_merge, run)
    return runs.select("digest", "keep_id", "n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical once each run of ASCII white space is one space; null equals the empty text. The row
    with the smallest identifier stays; null identifiers come last. Of rows that repeat identifier and text one stays.
    Other columns are ignored. An empty table gives no rows.
    """
    found = durable(docs.select(docs[id_col].alias("doc_id"), *digest_columns(docs[text_col])))
    merged = merge_runs(found).withColumnRenamed("n", "group_size")
    rows = found.groupBy("digest", "doc_id").agg(F.count("*").cast("int").alias("copies"))
    return (
        rows.join(merged, "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were; of rows that repeat identifier and text, one.

    Equality, nulls and empty tables are as in ``exact_dedup``. Rows whose text stands once stay where they are; only
    rows that may be copies are shuffled.
    """
    doc_id, text = docs[id_col], docs[text_col]
    tag = row_tag(doc_id, text).alias("tag")
    thin = durable(docs.select(*digest_columns(text), doc_id.alias("doc_id"), tag))
    groups = durable(merge_runs(thin.select("digest", "doc_id", "n_bytes")).where("n > 1").select(F.col("digest").alias("d"), F.col("keep_id").alias("k")))
    members = durable(thin.join(groups, F.col("digest") == F.col("d")).select("d", "tag", F.col("doc_id").eqNullSafe(F.col("k")).alias("first")))
    stays = members.where("first").groupBy("d").agg(F.min("tag").alias("k")).select("k", F.lit(True).alias("stays"))
    told = members.select(F.col("tag").alias("k")).distinct()
    doubtful = may_be_among(told)
    wide = docs.select(F.struct("*").alias("row"), tag)
    asked = wide.where(doubtful("tag")).join(told.join(stays, "k", "left").select("k", F.coalesce("stays", F.lit(False)).alias("stays")), F.col("tag") == F.col("k"), "left")
    # the bits' false alarms are in no group
    once = asked.where("stays is null").select("row").unionByName(asked.where("stays").dropDuplicates(["tag"]).select("row"))
    return wide.where(~doubtful("tag")).select("row").unionByName(once).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""

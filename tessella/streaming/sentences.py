"""Sentences as a stream: lexical and unknown edges of each, as they arrive.

Sentences come one by one and don't depend on each other, so the plan is a stateless map and two joins with the static
inventory; files of ``sent_id<TAB>words`` stand for whatever source delivers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens
from ..operators import chart


def read_sentences(spark: SparkSession, folder: str) -> DataFrame:
    part = F.split("value", "\t")
    lines = spark.readStream.text(folder).where(F.col("value").contains("\t"))
    return lines.select(part[0].cast("long").alias("sent_id"), tokens(part[1]).alias("words"))


def edges(sentences: DataFrame, inventory: DataFrame, longest: int) -> DataFrame:
    """(sent_id, i, j, src, tgt) with ``<unk>`` for single words that aren't a source phrase."""
    spans = chart.span_phrases(sentences, longest)
    targets = inventory.groupBy("src").agg(F.sort_array(F.collect_set("tgt")).alias("tgts"))
    met = spans.join(targets, "src", "left").where("tgts is not null or j = i + 1")
    return met.select("sent_id", "i", "j", "src", F.explode(F.coalesce("tgts", F.array(F.lit("<unk>")))).alias("tgt"))


def decode_stream(spark: SparkSession, folder: str, inventory: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    found = edges(read_sentences(spark, folder), inventory, chart.longest_source(inventory))
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()

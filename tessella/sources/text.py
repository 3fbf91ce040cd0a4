"""Readers of the text formats that phrase pairs, alignments, vectors and scores come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fields, tokens
from ..functions.vectors import unit


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of one text file with their numbers from 0. The format has no key but the line number.

    Lines of a block of the file have consecutive row numbers, so a table of the blocks' first rows and counts, as small
    as the list of its splits, gives every line its number without a sort.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("many"), F.min("at").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("start"))
    return lines.join(F.broadcast(starts), ["file", "block"]).select((F.col("start") + F.col("at") - F.col("first")).alias("n"), "value")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``source ||| target``; the sentence id is the line number."""
    side = fields(F.col("value"))
    return numbered_lines(spark, path).select(F.col("n").alias("sent_id"), tokens(side[0]).alias("src"), tokens(F.try_element_at(side, F.lit(2))).alias("tgt"))


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``i-j``, source to target from 0, in file order: (sent_id, ord, s, t)."""
    link = F.posexplode(tokens(F.col("value"))).alias("ord", "link")
    rows = numbered_lines(spark, path).select(F.col("n").alias("sent_id"), link)
    part = F.split("link", "-")
    return rows.select("sent_id", "ord", part[0].cast("int").alias("s"), part[1].cast("int").alias("t"))


def sentence_grammars(spark: SparkSession, folder: str) -> DataFrame:
    """Phrase pairs ``src ||| tgt ||| l-r`` of files ``grammar.{n}.gz``; the number in the name is the sentence id.

    A file is one sentence and gzip can't be split, so its lines come in order; ``ord`` numbers them within the file.
    """
    lines = spark.read.text(f"{folder}/grammar.*.gz").select(
        F.regexp_extract(F.col("_metadata.file_name"), r"grammar\.(\d+)\.gz", 1).cast("long").alias("sent_id"), "value", F.monotonically_increasing_id().alias("at")
    )
    side = fields(F.col("value"))
    span = F.split(side[2], "-")
    return lines.select(
        "sent_id",
        (F.row_number().over(Window.partitionBy("sent_id").orderBy("at")) - 1).alias("ord"),
        side[0].alias("src"),
        side[1].alias("tgt"),
        span[0].cast("int").alias("l"),
        span[1].cast("int").alias("r"),
    )


def vectors_of(lines: DataFrame) -> DataFrame:
    """(key, v) of ``lines(value)``: those of more than two fields, unit length; a zero vector stays zero."""
    rows = lines.select(tokens(F.col("value")).alias("w")).where(F.size("w") > 2)
    return rows.select(F.col("w")[0].alias("key"), unit(F.transform(F.slice("w", 2, F.size("w") - 1), lambda x: x.cast("double"))).alias("v"))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    return vectors_of(spark.read.text(path))


def skipgram_vectors(spark: SparkSession, path: str) -> DataFrame:
    """As ``word_vectors``; the header of two fields gives the rank, and ``<s>`` is the zero vector."""
    header = spark.read.text(path).select(tokens(F.col("value")).alias("w")).where(F.size("w") == 2).select(F.col("w")[1].cast("int").alias("rank"))
    start = header.limit(1).select(F.lit("<s>").alias("key"), F.expr("array_repeat(0D, rank)").alias("v"))
    return word_vectors(spark, path).where("key <> '<s>'").unionByName(start)


def phrase_vectors(spark: SparkSession, path: str, inventory: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, tgt, v) of lines ``src ||| tgt<TAB>v…``: known sources and known pairs only; no header, ``</s>`` or ``<UNK>`` target."""
    halves = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(halves) == 2).select(fields(halves[0]).alias("p"), tokens(halves[1]).alias("w")).where(F.size("p") == 2)
    out = rows.select(F.col("p")[0].alias("src"), F.col("p")[1].alias("tgt"), unit(F.transform("w", lambda x: x.cast("double"))).alias("v"))
    out = out.where((F.col("tgt") != "<UNK>") & (F.col("src") != "</s>"))
    return out.join(inventory.select("src").distinct(), "src", "left_semi").join(pairs.select("src", "tgt").distinct(), ["src", "tgt"], "left_semi")


def lm_groups(spark: SparkSession, phrases: str, scores: str) -> DataFrame:
    """Two files line by line: (row_id, tgt, score). A score below zero belongs to the phrase on its line and becomes its
    negative per word; any other closes the group. Of a target repeated in a group the last counts."""
    from ..operators.scoring import lm_scores

    both = numbered_lines(spark, scores).select("n", tokens(F.col("value"))[1].cast("double").alias("value")).join(
        numbered_lines(spark, phrases).select("n", F.col("value").alias("phrase")), "n"
    )
    side = fields(F.col("phrase"))
    return lm_scores(both.select("n", "value", F.try_element_at(side, F.lit(2)).alias("tgt"), F.size(tokens(F.try_element_at(side, F.lit(3)))).alias("n_words")))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Stop words or frequent words, one per line."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()

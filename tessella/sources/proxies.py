"""Stand-ins for a parallel corpus, built from the general test tables.

Conversations give sentence pairs (a user's turn and the answer to it), the diagonal gives alignments, lexical pairs and
their counts follow from these. They exercise the operators; they say nothing about translation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.counting import pair_counts
from ..operators.extraction import lexical_pairs


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", tokens(F.col("text")).alias("src"))
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), tokens(F.col("text")).alias("tgt"))
    return asked.join(told, ["conv_id", "turn"]).select((F.col("conv_id") * 4096 + F.col("turn")).cast("long").alias("sent_id"), "src", "tgt")


def alignments(pairs: DataFrame) -> DataFrame:
    n = F.least(F.size("src"), F.size("tgt"))
    i = F.explode(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: k < n)).alias("s")
    return pairs.select("sent_id", i).select("sent_id", F.col("s").alias("ord"), "s", F.col("s").alias("t"))


def phrase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = corpus(spark, sf_dir)
    return lexical_pairs(pairs, alignments(pairs))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_counts(phrase_pairs(spark, sf_dir))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase pairs with their sentences: sent_id, ord, src, tgt, l, r, words, row_id (by sentence, then order)."""
    pairs = corpus(spark, sf_dir)
    found = lexical_pairs(pairs, alignments(pairs))
    return found.join(pairs.select("sent_id", F.col("src").alias("words")), "sent_id").withColumn("row_id", F.col("sent_id") * 65536 + F.col("ord"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("int").alias("label"))


#: The same stand-ins as SQL, as common table expressions that queries' statements begin with.
SQL = r"""
turns AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda w: w <> '') AS w FROM conversations),
corpus AS (
  SELECT u.conv_id * 4096 + u.turn AS sent_id, u.w AS src, a.w AS tgt FROM turns u JOIN turns a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
),
align AS (SELECT sent_id, i AS ord, i AS s, i AS t FROM (SELECT sent_id, unnest(range(least(len(src), len(tgt)))) AS i FROM corpus)),
pp AS (
  SELECT sent_id, s AS ord, c.src[s + 1] AS src, string_agg(c.tgt[t + 1], ' ' ORDER BY ord) AS tgt, s AS l, s AS r
  FROM align JOIN corpus c USING (sent_id) GROUP BY sent_id, s, c.src
),
counts AS (SELECT src, tgt, count(*) AS n FROM pp GROUP BY src, tgt),
occ AS (SELECT pp.*, c.src AS words, sent_id * 65536 + ord AS row_id FROM pp JOIN corpus c USING (sent_id)),
vec AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)
"""

"""Held-out evaluation: rank of the gold candidate among its competitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scorable(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with exactly one label, and that not the unknown column 0."""
    one = ids.groupBy("row_id").agg(F.count("*").alias("k"), F.max("id").alias("id")).where("k = 1 and id <> 0")
    return rows.join(one.select("row_id"), "row_id", "left_semi")


def gold_ranks(scored: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, n_cands, rank, score) of examples of ``scored(key, tgt, score, is_gold)`` with more than one candidate.

    Candidates stand by score, null last, ties by target; rank is null if the gold candidate has no score. Groups are the
    candidates of one example, a few rows each; they aren't sorted, better ones are counted.
    """
    w = Window.partitionBy(key)
    better = (F.col("score") > F.col("gold")) | ((F.col("score") == F.col("gold")) & (F.col("tgt") < F.col("gold_tgt")))
    marked = scored.withColumn("gold", F.max(F.when(F.col("is_gold"), F.col("score"))).over(w)).withColumn("gold_tgt", F.max(F.when(F.col("is_gold"), F.col("tgt"))).over(w))
    found = marked.groupBy(key).agg(F.count("*").alias("n_cands"), F.first("gold").alias("score"), F.sum(F.when(better, 1).otherwise(0)).alias("above"))
    return found.where("n_cands > 1").select(key, "n_cands", F.when(F.col("score").isNotNull(), F.col("above") + 1).alias("rank"), "score")


def report(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean reciprocal rank, that of hard examples (rank above 1) and their number, mean squared error of the gold score,
    and the mean number of candidates: of all examples, per example whose gold has a score. No examples give nulls."""
    scored = F.col("rank").isNotNull()
    hard = F.col("rank") > 1
    out = [
        F.avg(1.0 / F.col("rank")).alias("mrr"),
        F.avg(F.when(hard, 1.0 / F.col("rank"))).alias("hard_mrr"),
        F.count(F.when(hard, 1)).alias("n_hard"),
        F.avg(F.when(scored, F.pow(1 - F.col("score"), 2))).alias("mse"),
        F.try_divide(F.sum("n_cands"), F.count(F.when(scored, 1))).alias("mean_cands"),
        F.count(F.when(scored, 1)).alias("n_scored"),
    ]
    return ranks.groupBy(*by).agg(*out) if by else ranks.agg(*out)

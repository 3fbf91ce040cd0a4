"""Context windows of phrases, on either side of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import zeros
from .lookup import summed_entries

BEGIN, END, OTHER = "<s>", "</s>", "<OTHER>"


def _edited(words: Column, far: bool, stop: Column | None, frequent: Column | None, position: bool) -> Column:
    """Stop words go, words that aren't frequent become ``<OTHER>``, then distances to the phrase are attached."""
    n = F.size(words)
    pairs = F.transform(words, lambda w, i: F.struct(w.alias("w"), (n - i if far else i + 1).alias("k")))
    if stop is not None:
        pairs = F.filter(pairs, lambda p: ~F.array_contains(stop, p["w"]))

    def shown(p: Column) -> Column:
        w = p["w"]
        if frequent is not None:
            w = F.when(F.array_contains(frequent, w), w).otherwise(F.lit(OTHER))
        return F.concat(w, F.lit("_dist"), p["k"].cast("string")) if position else w

    return F.transform(pairs, shown)


def source_context(words: Column, l: Column, r: Column, c: int, stop: Column | None = None, frequent: Column | None = None, position: bool = False) -> tuple[Column, Column]:
    """Left and right window of ``c`` words around the phrase ``[l, r]``.

    The left one begins with ``<s>`` once if it would start before the sentence, the right one ends with ``</s>`` once if
    it would run over the end. Boundaries are neither stopped nor decorated, and a stopped word isn't replaced by one
    further out.
    """
    n = F.size(words)
    begin = F.greatest(l - c, F.lit(0))
    left = _edited(F.slice(words, begin + 1, l - begin), True, stop, frequent, position)
    right = _edited(F.slice(words, r + 2, F.greatest(F.lit(0), F.least(F.lit(c), n - 1 - r))), False, stop, frequent, position)
    empty = F.array().cast("array<string>")
    return (
        F.concat(F.when(l - c < 0, F.array(F.lit(BEGIN))).otherwise(empty), left),
        F.concat(right, F.when((r + c >= n) & F.lit(c > 0), F.array(F.lit(END))).otherwise(empty)),
    )


def with_context(occurrences: DataFrame, c: int = 2, **options) -> DataFrame:
    left, right = source_context(F.col("words"), F.col("l"), F.col("r"), c, **options)
    return occurrences.withColumn("left_con", left).withColumn("right_con", right)


def both_sides(rows: DataFrame) -> DataFrame:
    """Rows with features on both sides. An inventory must be taken before this filter."""
    return rows.where((F.size("left_con") > 0) & (F.size("right_con") > 0))


def target_context(spans: DataFrame, align: DataFrame, targets: DataFrame, c: int = 2) -> DataFrame:
    """Windows around the target words aligned to ``spans(sent_id, l, r)``: no ``<s>`` on the left, one ``</s>`` on the right.

    Spans without an aligned word have no target side and are left out.
    """
    hit = spans.join(align, "sent_id").where(F.col("s").between(F.col("l"), F.col("r")))
    found = hit.groupBy("sent_id", "l", "r").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).join(targets, "sent_id")
    n, lo, hi = F.size("tgt"), F.col("lo"), F.col("hi")
    begin = F.greatest(lo - c, F.lit(0))
    right = F.slice("tgt", hi + 2, F.greatest(F.lit(0), F.least(F.lit(c), n - 1 - hi)))
    over = F.when(hi + c >= n, F.array(F.lit(END))).otherwise(F.array().cast("array<string>")) if c else F.array().cast("array<string>")
    return found.select("sent_id", "l", "r", F.slice("tgt", begin + 1, lo - begin).alias("left_con"), F.concat(right, over).alias("right_con"))


def gold_first(gold: Column, candidates: Column, most: int | None = None) -> Column:
    """The gold candidate, then the others; if it had been pruned, the last of the others makes room."""
    rest = F.filter(candidates, lambda x: x != gold)
    fit = F.when(F.array_contains(candidates, gold), rest).otherwise(F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))))
    out = F.concat(F.array(gold), fit)
    return F.slice(out, 1, most) if most else out


def context_features(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Long form of both windows: key, side, feature, pos."""
    sides = F.array(F.struct(F.lit("L").alias("side"), F.col("left_con").alias("f")), F.struct(F.lit("R").alias("side"), F.col("right_con").alias("f")))
    each = rows.select(key, F.explode(sides).alias("x")).select(key, "x.side", F.posexplode("x.f").alias("pos", "feature"))
    return each.select(key, "side", "feature", "pos")


def additive_context(features: DataFrame, vectors: DataFrame, dim: int, key: str = "row_id") -> DataFrame:
    """Sum of the features' vectors per row and side; unknown words and ``<s>`` count as zero."""
    v = vectors.where(F.col("key") != BEGIN).select(F.col("key").alias("id"), "v")
    return summed_entries(features.select(key, "side", F.col("feature").alias("id")), key, v, dim, ("side",), zeros=True)


def concatenated_context(features: DataFrame, vectors: DataFrame, dim: int, length: int, key: str = "row_id") -> DataFrame:
    """The features' vectors in text order, padded with zeros at the end to ``length`` blocks; unknown words give zeros."""
    v = vectors.select(F.col("key").alias("feature"), "v")
    found = features.join(v, "feature", "left").withColumn("v", F.when(F.col("feature") == BEGIN, zeros(dim)).otherwise(F.coalesce("v", zeros(dim))))
    joined = found.groupBy(key, "side").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"])).alias("v"))
    return joined.select(key, "side", F.slice(F.concat("v", zeros(dim * length)), 1, dim * length).alias("v"))

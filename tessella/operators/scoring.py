"""Candidate expansion, scores, and what is done to scores before they are printed."""

from __future__ import annotations

import math

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.numbering import running_total
from ..functions.text import printed
from ..functions.vectors import cosine, dot, unit


def candidates(rows: DataFrame, inventory: DataFrame, params: DataFrame) -> DataFrame:
    """Every row's source with all targets of the inventory; ``v`` is null for pairs without parameters."""
    return rows.join(inventory.select("src", "tgt"), "src").join(params.select("src", "tgt", "v"), ["src", "tgt"], "left")


def cca_score(context: Column, pair: Column) -> Column:
    """Cosine; null without parameters or for a zero vector."""
    return cosine(context, pair)


def skipgram_score(context: Column, pair: Column, rank: int) -> Column:
    """Halves of a double-width context are added; unit vectors are dotted, so that a zero context scores 0."""
    both = F.when(F.size(context) == 2 * rank, F.zip_with(F.slice(context, 1, rank), F.slice(context, rank + 1, rank), lambda x, y: x + y)).otherwise(context)
    return F.when(pair.isNotNull(), dot(unit(both), unit(pair)))


def glm_score(features: Column, beta: Column, alpha: Column | float = 1.0) -> Column:
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return F.when(beta.isNotNull(), a * dot(features, beta))


def lm_scores(lines: DataFrame) -> DataFrame:
    """``lines(n, value, tgt, n_words)`` to (row_id, tgt, score): values below zero are scores, the others close a group.

    Groups are numbered by the closing lines before them; of a target repeated in a group the last line counts.
    """
    closed = lines.withColumn("closes", (F.col("value") >= 0).cast("long"))
    scored = running_total(closed, "n", "closes", "row_id").where("value < 0")
    return scored.groupBy("row_id", "tgt").agg(F.max_by(-F.col("value") / F.col("n_words"), F.col("n")).alias("score"))


VARIANTS = ["lm", "e_f", "lm_e_f", "f_e", "lm_f_e"]


def source_channel(lm: DataFrame, frequencies: DataFrame, rows: DataFrame) -> DataFrame:
    """Five scores per row and candidate: language model, log10 P(e|f), both, log10 P(f|e), both. Long form by ``variant``.

    ``lm(row_id, tgt, score)`` holds positive costs, whose negatives are scores. A pair that has no frequency scores null
    under every variant.
    """
    found = rows.select("row_id", "src").join(lm, "row_id").join(frequencies.select("src", "tgt", "log_e_f", "log_f_e"), ["src", "tgt"], "left")
    s = F.when(F.col("log_e_f").isNotNull(), -F.col("score"))
    values = dict(zip(VARIANTS, (s, F.col("log_e_f"), s + F.col("log_e_f"), F.col("log_f_e"), s + F.col("log_f_e")), strict=True))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("score")) for k, v in values.items()]))
    return found.select("row_id", "src", "tgt", each.alias("x")).select("row_id", "src", "tgt", "x.variant", "x.score")


def softmax(score: Column, group: list[str]) -> Column:
    """Over the scores of the group that aren't null; shifted by the largest, which changes nothing but overflow."""
    w = Window.partitionBy(*group)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def range_normalised(score: Column, group: list[str], only_positive: bool = False, log: bool = False) -> Column:
    """Distance to the mean in units of the range; ``only_positive`` moves the least to 0 and ``log`` adds 1. A flat group gets 1/n each."""
    w = Window.partitionBy(*group)
    low, high, mean = F.min(score).over(w), F.max(score).over(w), F.avg(score).over(w)
    span = high - low
    out = F.try_divide(score - mean, span)
    if only_positive:
        out = out - F.try_divide(low - mean, span)
    if log:
        out = out + 1
    return F.when(score.isNotNull(), F.when(span == 0, 1.0 / F.count(score).over(w)).otherwise(out))


def angular(score: Column) -> Column:
    """1 - angle / pi, with cosines clamped against rounding."""
    return 1 - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), score))) / math.pi


def log_score(score: Column) -> Column:
    return -F.log10(score)


def ordered(group: list[str], score: str = "score", tie: str = "tgt") -> Window:
    """Best first, null last, ties by ``tie``."""
    return Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), tie)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def post_processed(scored: DataFrame, group: list[str], normalise: str = "none", only_positive: bool = False, log: bool = False, rank: bool = False) -> DataFrame:
    """Normalised score, rank, printed score, best, on/off and logistic columns of ``scored(…, tgt, score)``.

    normalise: none, exp or range. ``log`` prints -log10 and needs ``only_positive``; otherwise ``rank`` prints 1 / rank.
    """
    if log and not only_positive:
        raise ValueError("log needs only_positive")
    if normalise not in ("none", "exp", "range"):
        raise ValueError(f"no normalisation {normalise!r}")
    score = F.col("score")
    norm_score = softmax(score, group) if normalise == "exp" else range_normalised(score, group, only_positive, log) if normalise == "range" else angular(score) if only_positive else score
    out = scored.withColumn("norm_score", norm_score)
    out = out.withColumn("rank", F.row_number().over(ordered(group, "norm_score")))
    has = F.col("norm_score").isNotNull()
    shown = log_score(F.col("norm_score")) if log else 1.0 / F.col("rank") if rank else F.col("norm_score")
    out = out.withColumn("shown", F.when(has, shown))
    return out.withColumn("best", (has & (F.col("rank") == 1)).cast("int")).withColumn("off", (~has).cast("int")).withColumn("logit", logistic(F.col("shown")))


def second_order(context: Column, pair: Column) -> Column:
    """``op{i}=%.3g …`` of the outer product, row by row, of the values as they are printed; null without one of them."""

    def show(contexts: pd.Series, pairs: pd.Series) -> pd.Series:
        seen = lambda v: [float(f"{x:.3g}") for x in v]
        both = [None if c is None or p is None else [x * y for x in seen(c) for y in seen(p)] for c, p in zip(contexts, pairs, strict=True)]
        return pd.Series([None if v is None else " ".join(f"op{i}={x:.3g}" for i, x in enumerate(v)) for v in both], dtype=object)

    return F.pandas_udf(show, StringType())(context, pair)


def representation(prefix: str, vector: Column) -> Column:
    """``{prefix}_dim{i}=%.3g …`` of an array; the numbers need printf's general format, so they pass an Arrow UDF as one string each."""
    return F.array_join(F.transform(printed_all(vector, "%.3g"), lambda x, i: F.concat(F.lit(f"{prefix}_dim"), i.cast("string"), F.lit("="), x)), " ")


def printed_all(vector: Column, spec: str) -> Column:
    def show(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else [spec % x for x in v])

    return F.pandas_udf(show, ArrayType(StringType()))(vector)


def rule_line(scored: DataFrame, log: bool = False, flags: bool = True, plain: bool = False, best: bool = False, logistic_feature: bool = False) -> DataFrame:
    """Adds ``line``: ``lhs ||| src ||| tgt ||| features`` from the columns of ``post_processed``."""
    has = F.col("shown").isNotNull()
    parts: list[Column] = []
    if flags:
        parts.append(F.when(F.col("off") == 1, F.lit("cca_off=1")).otherwise(F.lit("cca_on=1")))
    if not plain:
        parts.append(F.when(has, F.concat(F.lit("cca_score="), printed(F.col("shown"), "%.3f" if log else "%.5g"))))
        if best:
            parts.append(F.when(F.col("best") == 1, F.lit("cca_best=1")))
        if logistic_feature:
            parts.append(F.when(has, F.concat(F.lit("cca_log="), printed(F.col("logit"), "%.3f"))))
    return scored.withColumn("line", F.concat_ws(" ||| ", "lhs", "src", "tgt", F.concat_ws(" ", *parts)))



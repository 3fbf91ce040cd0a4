"""Model training on phrase-pair data: CCA, ridge models, shrinkage, matching sets, cost-sensitive and neural classifiers.

Where an external learner would be called, Spark ML or the ridge solver takes its place; rankings compare, weights don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import once, sum_vectors, unit
from ..session import durable
from . import linalg, scoring


def context_cca(left: DataFrame, right: DataFrame, p: int, q: int, k: int, gamma: float = 1e-5, whitening: str = "full", n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Projections of left and right contexts, (id, v)."""
    u, v, _ = linalg.fit_cca(left, right, p, q, k, gamma, gamma, whitening, n)
    return u, v


def two_step_cca(left: DataFrame, right: DataFrame, pairs: DataFrame, sizes: tuple[int, int, int], ranks: tuple[int, int], gammas: tuple[float, float] = (1e-5, 1e-5), whitening: str = "full", n: int | None = None) -> dict:
    """Context CCA, then CCA of the projected contexts (left and right side by side) with one-hot pairs.

    After ppmi the second step whitens fully. The projections are tables (id, v), to be saved with their vocabularies by
    ``sinks.save_tables``; ``correlations`` are the second step's.
    """
    u, v = (durable(t) for t in context_cca(left, right, sizes[0], sizes[1], ranks[0], gammas[0], whitening, n))
    dense = durable(context_vectors(left, right, u, v, ranks[0]))
    cells = dense.select("row_id", F.posexplode("v").alias("id", "val"))
    a, b, s = linalg.fit_cca(cells, pairs, 2 * ranks[0], sizes[2], min(ranks[1], 2 * ranks[0], sizes[2]), gammas[1], gammas[1], "full" if whitening == "ppmi" else whitening, n)
    return {"left": u, "right": v, "context": a, "pair": b, "correlations": s}


def context_vectors(left: DataFrame, right: DataFrame, left_projection: DataFrame, right_projection: DataFrame, rank: int) -> DataFrame:
    """(row_id, v): both projected contexts side by side; rows with one side only get zeros for the other."""
    a = linalg.projected(left, left_projection).withColumnRenamed("v", "a")
    b = linalg.projected(right, right_projection).withColumnRenamed("v", "b")
    zero = F.array_repeat(F.lit(0.0), rank)
    return a.join(b, "row_id", "full").select("row_id", F.concat(F.coalesce("a", zero), F.coalesce("b", zero)).alias("v"))


def glm(contexts: DataFrame, pairs: DataFrame, dim: int, n_pairs: int, gamma: float) -> DataFrame:
    """Ridge regression of one-hot pairs on [context, 1], a row (id, v) per pair; the intercept is shrunk like the rest."""
    with_one = contexts.select("row_id", F.posexplode(F.concat("v", F.array(F.lit(1.0)))).alias("id", "val"))
    return linalg.ridge(with_one, pairs, dim + 1, n_pairs, gamma)


def shrinkage(candidates: DataFrame) -> DataFrame:
    """(j, alpha) from held-out ``candidates(row_id, x, beta, is_gold)`` with more than one candidate a row.

    alpha_j = (X_j . Y) / (X_j . X_j), X_j stacking beta_jk * x_j over all candidates, Y one for gold ones.
    """
    many = candidates.withColumn("k", F.count("*").over(Window.partitionBy("row_id"))).where("k > 1")
    each = many.select("is_gold", F.posexplode(F.zip_with("x", "beta", lambda a, b: a * b)).alias("j", "xj"))
    sums = each.groupBy("j").agg(F.sum(F.when(F.col("is_gold"), F.col("xj")).otherwise(0.0)).alias("xy"), F.sum(F.col("xj") * F.col("xj")).alias("xx"))
    return sums.select("j", F.coalesce(F.try_divide("xy", "xx"), F.lit(0.0)).alias("alpha"))


def hard_rows(scores: DataFrame) -> DataFrame:
    """Rows of ``scores(row_id, cost, is_gold)`` except those whose gold candidate is the cheapest already."""
    best = scores.groupBy("row_id").agg(F.min("cost").alias("least"), F.min(F.when(F.col("is_gold"), F.col("cost"))).alias("gold"))
    return best.where("gold > least").select("row_id")


def matching_set(candidates: DataFrame) -> DataFrame:
    """Training rows (row_id, tgt, other, label) of ``candidates(row_id, tgt, is_gold)``: for every other candidate one
    negative and one repeat of the positive, so that labels balance."""
    gold = candidates.where("is_gold").select("row_id", F.col("tgt").alias("gold"))
    others = candidates.where("not is_gold").select("row_id", F.col("tgt").alias("other"))
    met = gold.join(others, "row_id")
    label = F.explode(F.array(F.struct(F.lit(-1).alias("label"), F.col("other").alias("tgt")), F.struct(F.lit(1).alias("label"), F.col("gold").alias("tgt"))))
    return met.select("row_id", "other", label.alias("x")).select("row_id", "x.tgt", "other", "x.label")


def label_costs(candidates: DataFrame, uniform: bool = False) -> DataFrame:
    """Cost per candidate of ``candidates(row_id, tgt, n, is_gold)``: gold 0; others 1, or by frequency
    (n + 1) * size / (sum of counts - gold's count), where size - 1 is the denominator if that sum is 0."""
    w = Window.partitionBy("row_id")
    size = F.count("*").over(w)
    rest = F.sum("n").over(w) - F.max(F.when(F.col("is_gold"), F.col("n"))).over(w)
    cost = F.lit(1.0) if uniform else F.try_divide((F.col("n") + 1) * size, F.when(rest == 0, size - 1).otherwise(rest)).cast("double")
    return candidates.withColumn("cost", F.round(F.when(F.col("is_gold"), F.lit(0.0)).otherwise(cost), 1))


def cost_regression(contexts: DataFrame, costs: DataFrame, dim: int, n_labels: int, gamma: float = 1.0) -> DataFrame:
    """One-against-all regression of costs on [context, 1]: row j of (id, v) predicts the cost of label j (``costs(row_id, id, cost)``)."""
    x = contexts.select("row_id", F.posexplode(F.concat("v", F.array(F.lit(1.0)))).alias("id", "val"))
    return linalg.ridge(x, costs.select("row_id", "id", F.col("cost").alias("val")), dim + 1, n_labels, gamma)


def cost_scores(predicted: DataFrame) -> DataFrame:
    """Score = -cost of ``predicted(row_id, tgt, cost, chosen)``; a chosen label that isn't the best of its row gains 1e-5."""
    w = Window.partitionBy("row_id")
    low = F.min("cost").over(w)
    lift = F.when(F.col("chosen") & (F.col("cost") > low), -low + 1e-5).otherwise(-F.col("cost"))
    return predicted.withColumn("score", lift)


def matching_scores(model, candidates: DataFrame) -> DataFrame:
    """Adds ``score`` to ``candidates(…, ctx, v)``: the chance that the pair fits its context, as ``matching_network`` has
    learned it from ``matching_features``; null for pairs without parameters."""
    scored = classify(model, candidates.where("v is not null").withColumn("pair", F.col("v")).withColumn("v", matching_features(F.col("ctx"), F.col("v"))))
    scored = scored.select(*[F.col(c) if c != "v" else F.col("pair").alias("v") for c in candidates.columns], F.col("probs")[1].alias("score"))
    return scored.unionByName(candidates.where("v is null").withColumn("score", F.lit(None).cast("double")))


def matching_features(context: Column, pair: Column) -> Column:
    """Unit context, unit pair, and their products, in which a network of one layer sees their angle."""
    both = F.struct(unit(context).alias("a"), unit(pair).alias("b"))
    return once(both, lambda u: F.concat(u["a"], u["b"], F.zip_with(u["a"], u["b"], lambda x, y: x * y)))


def regression_scores(betas: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds ``score`` to ``candidates(row_id, …, ctx, label)``: minus the cost that ``cost_regression`` predicts for the
    label (``betas(id, v)``, one row a label); null for labels without one."""
    met = candidates.join(betas.select(F.col("id").alias("label"), F.col("v").alias("beta")), "label", "left")
    with_one = F.concat("ctx", F.array(F.lit(1.0)))
    cost = F.aggregate(F.zip_with(with_one, F.col("beta"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    predicted = met.withColumn("cost", cost).drop("beta")
    best = F.min(F.struct(F.col("cost").isNull(), "cost", "label")).over(Window.partitionBy("row_id"))["label"]
    return cost_scores(predicted.withColumn("chosen", F.col("label") == best)).drop("cost", "chosen")


def label_scores(model, candidates: DataFrame) -> DataFrame:
    """Adds ``score`` to ``candidates(…, ctx, label)``: the classifier's probability of the candidate's label; null for
    labels it doesn't know."""
    scored = classify(model, candidates.withColumn("v", F.col("ctx")))
    return scored.select(*candidates.columns, F.try_element_at("probs", (F.col("label") + 1).cast("int")).alias("score"))


def skipgram_model(contexts: DataFrame, pairs: DataFrame, rows: DataFrame, rank: int) -> DataFrame:
    """(row_id, src, tgt, score): candidates of ``rows(row_id, src, feature)`` by skip-gram vectors.

    ``contexts(key, v)`` and ``pairs(src, tgt, v)`` are read from files and not trained. A row's context is the sum of its
    known features' vectors, zero without any.
    """
    known = rows.join(contexts.select(F.col("key").alias("feature"), F.col("v").alias("x")), "feature", "left")
    sums = sum_vectors(known.select("row_id", F.coalesce("x", F.array_repeat(F.lit(0.0), rank)).alias("x")), ["row_id"], "x", "ctx")
    cands = rows.select("row_id", "src").distinct().join(pairs.select("src", "tgt", "v"), "src").join(sums, "row_id")
    return cands.select("row_id", "src", "tgt", scoring.skipgram_score(F.col("ctx"), F.col("v"), rank).alias("score"))


def svm_lines(contexts: DataFrame, ids: DataFrame) -> DataFrame:
    """(row_id, line): ``id dim:value …``, both from 1, of ``contexts(row_id, v)`` whose row has exactly one of ``ids(row_id, id)``."""
    one = ids.groupBy("row_id").agg(F.count("*").alias("k"), F.max("id").alias("id")).where("k = 1")
    entries = F.transform(scoring.printed_all(F.col("v"), "%.5g"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x))
    return contexts.join(one, "row_id").select("row_id", F.concat((F.col("id") + 1).cast("string"), F.lit(" "), F.array_join(entries, " ")).alias("line"))


def indicator_features(features: DataFrame, source: Column | None = None) -> DataFrame:
    """Sparse indicators ``L{id}`` and ``R{id}`` per row, label-dependent ones with ``_{source}`` behind."""
    name = F.concat("side", F.col("id").cast("string"))
    if source is not None:
        name = F.concat(name, F.lit("_"), source.cast("string"))
    return features.withColumn("name", name).groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("indicators"))


def _vectorised(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("features", array_to_vector("v"))


def matching_network(rows: DataFrame, rank: int, seed: int = 42, steps: int = 40, size: int | None = None):
    """A one-layer network for ``rows(v, label)`` with labels 0 and 1; ``v`` is context and pair side by side, of ``size`` values."""
    return mlp_classifier(rows, rank, seed, steps, None if size is None else (size, 2))


def mlp_classifier(rows: DataFrame, hidden: int, seed: int = 42, steps: int = 60, sizes: tuple[int, int] | None = None):
    """Multilayer perceptron on ``rows(v, label)``, labels 0 to k - 1. Where the caller knows ``sizes``, of ``v`` and k, the
    rows are computed for the fit only."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    if sizes is None:
        found = rows.agg(F.max(F.size("v")), F.max("label")).first()
        sizes = int(found[0]), int(found[1]) + 1
    layers = [sizes[0], hidden, sizes[1]]
    fit = MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=steps, featuresCol="features", labelCol="label")
    return fit.fit(_vectorised(rows).withColumn("label", F.col("label").cast("double")))


def classify(model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction`` and the array ``probs``."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_vectorised(rows))
    return out.withColumn("probs", vector_to_array("probability")).drop("features", "rawPrediction", "probability")

"""Queries: Gram products, whitening, projections, CCA, ridge, classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, norm, outer, sum_vectors, unit
from ..operators import context as con
from ..operators import counting as cnt
from ..operators import linalg as la
from ..operators import models as mo
from ..operators import scoring as sc
from ..operators.lookup import summed_entries
from ..session import durable
from ..sources import proxies as px
from .count_plans import LONG, _rounded
from .score_plans import CHANNEL, SCORED, _channel, cosine_scored, label_means
from .text_plans import DICTIONARY, _context_sql, _with, word_vectors


def _views(spark, sf):
    """The two halves of the vectors as sparse matrices of 32 columns each, and labels as one-hot columns."""
    vec = px.vectors(spark, sf)
    cells = vec.select(F.col("vec_id").alias("row_id"), F.posexplode("v").alias("i", "val"), "label")
    x = cells.where("i < 32").select("row_id", F.col("i").cast("long").alias("id"), "val")
    y = cells.where("i >= 32").select("row_id", (F.col("i") - 32).cast("long").alias("id"), "val")
    z = vec.select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("id"), F.lit(1.0).alias("val"))
    return x, y, z


XY = LONG + """, x AS (SELECT vec_id AS row_id, i AS id, x AS val FROM long WHERE i < 32), y AS (SELECT vec_id AS row_id, i - 32 AS id, x AS val FROM long WHERE i >= 32),
z AS (SELECT vec_id AS row_id, label::BIGINT AS id, 1.0::DOUBLE AS val FROM vec),
xy AS (SELECT x.id AS i, y.id AS j, sum(x.val * y.val) AS val FROM x JOIN y USING (row_id) GROUP BY ALL)"""


def l1_cross_covariance(spark, sf):
    x, y, _ = _views(spark, sf)
    return _rounded(la.cross_covariance(x, y), "val")


def l1_context_gram(spark, sf):
    """Contexts by phrase pairs: the sparse product that CCA starts from."""
    rows = con.with_context(px.occurrences(spark, sf), 2)
    _, x = cnt.context_matrix(con.context_features(rows), 1)
    _, ids = cnt.pair_vocabulary(px.occurrences(spark, sf), 1)
    return la.cross_covariance(x, ids.withColumn("val", F.lit(1.0)))


def _context_gram_sql():
    from .count_plans import CELLS

    return _context_sql(2) + CELLS + """, t AS (SELECT src, tgt, row_id, row_number() OVER (PARTITION BY src, tgt ORDER BY row_id) AS o FROM occ),
v AS (SELECT src, tgt, row_number() OVER (ORDER BY row_id) - 1 AS j FROM t WHERE o = 2), p AS (SELECT row_id, j FROM occ JOIN v USING (src, tgt))
SELECT id AS i, j, sum(val) AS val FROM cells JOIN p USING (row_id) GROUP BY ALL"""


def l2_centred_product(spark, sf):
    x, y, _ = _views(spark, sf)
    n = px.vectors(spark, sf).count()
    return _rounded(la.centre_correction(la.cross_covariance(x, y), x, y, n), "val")


L2 = _with(XY + """, n AS (SELECT count(*) AS n FROM vec), mx AS (SELECT id, sum(val) AS s FROM x GROUP BY id), my AS (SELECT id, sum(val) AS s FROM y GROUP BY id)
SELECT i, j, round(val - mx.s * my.s / n, 6) AS val FROM xy JOIN mx ON mx.id = i JOIN my ON my.id = j, n""")


def l3_diagonal_whitening(spark, sf):
    x, y, _ = _views(spark, sf)
    return _rounded(la.whitened(la.cross_covariance(x, y), x, y, 0.5, 0.25), "val")


L3 = _with(XY + """, mx AS (SELECT id, 1 / sqrt(sum(val * val) + 0.5) AS w FROM x GROUP BY id), my AS (SELECT id, 1 / sqrt(sum(val * val) + 0.25) AS w FROM y GROUP BY id)
SELECT i, j, round(val * mx.w * my.w, 6) AS val FROM xy JOIN mx ON mx.id = i JOIN my ON my.id = j""")


def l4_ppmi(spark, sf):
    """Context features against source words of the same occurrence."""
    occ = px.occurrences(spark, sf)
    _, x = cnt.context_matrix(con.context_features(con.with_context(occ, 2)), 1)
    words = cnt.vocabulary(occ.select("row_id", F.col("src").alias("w")), 1, "w", "row_id").withColumnRenamed("type", "src")
    y = occ.select("row_id", "src").join(words, "src").select("row_id", "id", F.lit(1.0).alias("val"))
    return _rounded(la.shifted_ppmi(la.cross_covariance(x, y), x, y, occ.count(), 2.0), "val")


def _ppmi_sql():
    from .count_plans import CELLS

    return _context_sql(2) + CELLS + """, t AS (SELECT src, row_id, row_number() OVER (PARTITION BY src ORDER BY row_id) AS o FROM occ),
w AS (SELECT src, row_number() OVER (ORDER BY row_id) - 1 AS j FROM t WHERE o = 2), p AS (SELECT row_id, j FROM occ JOIN w USING (src)),
xy AS (SELECT id AS i, j, sum(val) AS c FROM cells JOIN p USING (row_id) GROUP BY ALL), cx AS (SELECT id AS i, sum(val) + 1 AS cx FROM cells GROUP BY id), cy AS (SELECT j, count(*) + 1 AS cy FROM p GROUP BY j)
SELECT i, j, round(v, 6) AS val FROM (SELECT i, j, ln((SELECT count(*) FROM occ) * c / (cx * cy)) - ln(2.0) AS v FROM xy JOIN cx USING (i) JOIN cy USING (j)) WHERE v > 0"""


def _values(spark, **columns):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(columns))


def l5_identity_svd(spark, sf):
    x, y, _ = _views(spark, sf)
    _, _, s = la.fit_cca(x, y, 32, 32, 5, 0.0, 0.0, "identity")
    return _values(spark, k=np.arange(5), sigma=np.round(s, 6))


def l6_cca(spark, sf):
    """Canonical correlations with a ridge, and how far the projections are from whitening the views (0 up to the ridge)."""
    x, y, _ = _views(spark, sf)
    left, _, s = la.fit_cca(x, y, 32, 32, 5, 1e-5, 1e-5)
    u = la.as_array(left, 32)
    xx = la.dense(la.cross_covariance(x, x), 32, 32)
    off = np.abs(u.T @ (xx + 1e-5 * np.eye(32)) @ u - np.eye(5)).max(axis=1)
    return _values(spark, k=np.arange(5), correlation=np.round(s, 6), off=np.round(off, 6))


def l7_ridge(spark, sf):
    """Fitted values of labels by vectors: residual sum and the normal equations' largest violation."""
    x, _, z = _views(spark, sf)
    beta = la.as_array(la.ridge(x, z, 32, 10, 1.0), 10).T
    return _values(spark, feature=np.arange(32), label0=np.round(beta[:, 0], 6), label9=np.round(beta[:, 9], 6))


def l8_randomised_svd(spark, sf):
    x, y, _ = _views(spark, sf)
    _, s, _ = la.randomised_svd(la.cross_covariance(x, y), 5, extra=16, passes=3)
    return _values(spark, k=np.arange(5), sigma=np.round(s, 5))


def l9_projection(spark, sf):
    """Context cells times the dictionary's vectors (by column id)."""
    rows = con.with_context(px.occurrences(spark, sf), 2)
    vocab, cells = cnt.context_matrix(durable(con.context_features(rows)), 1)
    vocab = durable(vocab)
    table = vocab.join(word_vectors(spark, sf).withColumnRenamed("key", "type"), "type").select("id", "v")
    out = summed_entries(cells, "row_id", table, 64)
    return out.select("row_id", F.round(F.col("v")[0], 6).alias("v0"), F.round(F.col("v")[63], 6).alias("v63"))


L9 = _context_sql(2) + DICTIONARY + """, known AS (SELECT feature FROM feat GROUP BY feature HAVING count(*) > 1)
SELECT row_id, round(sum(v[1]), 6) AS v0, round(sum(v[64]), 6) AS v63 FROM feat JOIN known USING (feature) JOIN dict ON key = feature GROUP BY row_id"""


def l10_concatenated(spark, sf):
    rows = con.with_context(px.occurrences(spark, sf), 2)
    features = con.context_features(rows).where("side = 'L'")
    vocab = cnt.context_vocabulary(features, 1)
    ids = features.join(vocab.withColumnRenamed("type", "feature"), "feature").select("row_id", "pos", "id")
    table = vocab.select("id", F.array((F.col("id") + 1).cast("double"), (F.col("id") * 2).cast("double")).alias("v"))
    out = la.concatenated_projection(ids, table, 2, 3)
    return out.select("row_id", *[F.col("v")[k].alias(f"v{k}") for k in range(6)])


L10 = _context_sql(2) + """, feat AS (SELECT row_id, unnest(left_con) AS feature, generate_subscripts(left_con, 1) - 1 AS pos FROM ctx),
o AS (SELECT feature, row_id * 256 + pos AS spot, row_number() OVER (PARTITION BY feature ORDER BY row_id * 256 + pos) AS rn FROM feat),
vocab AS (SELECT feature, row_number() OVER (ORDER BY spot) - 1 AS id FROM o WHERE rn = 2),
l AS (SELECT row_id, list(id ORDER BY pos) AS ids FROM feat JOIN vocab USING (feature) GROUP BY row_id)
SELECT row_id, coalesce(ids[1] + 1.0, 0)::DOUBLE AS v0, coalesce(ids[1] * 2.0, 0)::DOUBLE AS v1, coalesce(ids[2] + 1.0, 0)::DOUBLE AS v2, coalesce(ids[2] * 2.0, 0)::DOUBLE AS v3, coalesce(ids[3] + 1.0, 0)::DOUBLE AS v4, coalesce(ids[3] * 2.0, 0)::DOUBLE AS v5 FROM l"""


def l11_back_off(spark, sf):
    rows = con.with_context(px.occurrences(spark, sf), 2, position=True)
    features = con.context_features(rows)
    vocab, _ = cnt.context_matrix(features, 3, position=True)
    out = la.backed_off(features, vocab).join(vocab, "id")
    return out.groupBy("type").agg(F.count("*").alias("n"))


L11 = _context_sql(2, position=True) + """, feat AS (SELECT unnest(list_concat(left_con, right_con)) AS feature FROM ctx), c AS (SELECT feature, count(*) AS n FROM feat GROUP BY feature)
SELECT CASE WHEN n > 3 THEN feature ELSE '<unk>' || regexp_extract(feature, '(_dist[0-9]+)$', 1) END AS type, sum(n)::BIGINT AS n FROM c GROUP BY ALL"""


def l12_l14_vectors(spark, sf):
    """Norm, unit length, dot product, cosine and outer product of the vectors' halves."""
    vec = px.vectors(spark, sf).select("vec_id", F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"))
    a, b = F.col("a"), F.col("b")
    rows = vec.select("vec_id", norm(a).alias("n"), unit(a)[0].alias("u"), dot(a, b).alias("d"), cosine(a, b).alias("c"), outer(a, b)[33].alias("o"))
    return _rounded(rows, "n", "u", "d", "c", "o")


L12 = _with(""", h AS (SELECT vec_id, v[1:32] AS a, v[33:64] AS b FROM vec), k AS (SELECT *, sqrt(list_dot_product(a, a)) AS n FROM h)
SELECT vec_id, round(n, 6) AS n, round(a[1] / n, 6) AS u, round(list_dot_product(a, b), 6) AS d, round(list_cosine_similarity(a, b), 6) AS c, round(a[2] * b[2], 6) AS o FROM k""")


def l15_vector_sums(spark, sf):
    out = sum_vectors(px.vectors(spark, sf), ["label"], "v", "v")
    return out.select("label", F.posexplode("v").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


L15 = _with(LONG + " SELECT label::INT AS label, i::INT AS i, round(sum(x), 6) AS x FROM long GROUP BY ALL")


def m2_two_step_cca(spark, sf):
    """Correlations of the halves' joint space with labels, after a first step of rank 4."""
    x, y, z = _views(spark, sf)
    model = mo.two_step_cca(x, y, z, (32, 32, 10), (4, 5))
    return _values(spark, k=np.arange(5), correlation=np.round(model["correlations"], 6))


def m3_glm(spark, sf):
    vec = px.vectors(spark, sf)
    contexts = vec.select(F.col("vec_id").alias("row_id"), "v")
    beta = la.as_array(mo.glm(contexts, _views(spark, sf)[2], 64, 10, 1.0), 10).T
    return _values(spark, feature=np.arange(65), label0=np.round(beta[:, 0], 6), label9=np.round(beta[:, 9], 6))


def m4_shrinkage(spark, sf):
    rows = cosine_scored(spark, sf).where("v is not null").select("row_id", F.col("ctx").alias("x"), F.col("v").alias("beta"), "is_gold")
    return _rounded(mo.shrinkage(rows), "alpha")


M4 = _with(SCORED + """, c AS (SELECT vec_id, k AS j, v[k + 1] * m[k + 1] AS xj, mv.label = vec.label AS g FROM vec, mv, range(0, 64) t(k) WHERE mv.label <> 9)
SELECT j::INT AS j, round(sum(xj) FILTER (g) / sum(xj * xj), 6) AS alpha FROM c GROUP BY j""")


def m5_matching_set(spark, sf):
    cands = cosine_scored(spark, sf).where("score is not null").select("row_id", "tgt", "is_gold")
    return mo.matching_set(cands)


M5 = _with(SCORED + """, s AS (SELECT * FROM scored WHERE score IS NOT NULL), p AS (SELECT a.row_id, a.tgt AS gold, b.tgt AS other FROM s a JOIN s b USING (row_id) WHERE a.is_gold AND NOT b.is_gold)
SELECT row_id, other AS tgt, other, -1 AS label FROM p UNION ALL SELECT row_id, gold, other, 1 FROM p""")


def m6_hard_rows(spark, sf):
    rows = _channel(spark, sf).where("variant = 'lm'").select("row_id", (-F.col("score")).alias("cost"), "is_gold")
    return mo.hard_rows(rows)


M6 = _with(CHANNEL + " SELECT row_id FROM channel WHERE variant = 'lm' GROUP BY row_id HAVING min(-score) FILTER (tgt = gold) > min(-score)")


def _parted(spark, sf):
    """Candidates of all rows, and of them those of rows to learn from and to score: a tenth is held out."""
    cands = cosine_scored(spark, sf).drop("score").withColumn("label", F.col("tgt").cast("long"))
    held = cnt.held_out(px.vectors(spark, sf).select(F.col("vec_id").alias("row_id")), 0.1)
    return cands.join(held, "row_id", "left_anti"), cands.join(held, "row_id", "left_semi")


def _candidate_scores(scored):
    return _rounded(scored.select("row_id", "tgt", "score", "is_gold"), "score")


def m7_matching_network(spark, sf):
    """How well a matching network tells held-out rows' gold candidates from the others."""
    # no filter on the score: it would be pushed below the joins, and the network asked about every row's candidates
    hits = _matched(spark, sf).select(F.col("is_gold").cast("int").alias("label"), ((F.col("score") > 0.5) == F.col("is_gold")).cast("double").alias("hit"))
    return hits.groupBy("label").agg(F.count("hit").alias("n"), F.avg("hit").alias("accuracy")).where("n > 0")


def _matched(spark, sf):
    learn, score = _parted(spark, sf)
    known = learn.where("v is not null")
    pairs = mo.matching_set(known.select("row_id", "tgt", "is_gold"))
    # vectors join the pairs of names: contexts by row, the labels' few by label
    vec = px.vectors(spark, sf)
    params = label_means(vec).select(F.col("label").cast("string").alias("tgt"), "v")
    met = pairs.join(vec.select(F.col("vec_id").alias("row_id"), F.col("v").alias("ctx")), "row_id").join(F.broadcast(params), "tgt")
    rows = met.select(mo.matching_features(F.col("ctx"), F.col("v")).alias("v"), ((F.col("label") + 1) / 2).cast("int").alias("label"))
    size = vec.agg(F.max(F.size("v"))).first()[0]
    return mo.matching_scores(mo.matching_network(rows, 8, size=3 * size), score)


def c5_matching_scores(spark, sf):
    """Scores of held-out rows' candidates by a matching network; none for pairs without parameters."""
    return _candidate_scores(_matched(spark, sf))


def _regressed(spark, sf):
    """Costs of the labels by their frequency, regressed on contexts of rows that aren't held out; label 9 isn't learned."""
    learn, score = _parted(spark, sf)
    sizes = px.vectors(spark, sf).groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))
    known = learn.where("v is not null")
    rows = known.join(known.where("is_gold").select("row_id"), "row_id", "left_semi").join(sizes, "label")
    costs = mo.label_costs(rows.select("row_id", "tgt", "label", "n", "is_gold")).select("row_id", F.col("label").alias("id"), "cost")
    contexts = rows.where("is_gold").select("row_id", F.col("ctx").alias("v"))
    return mo.regression_scores(mo.cost_regression(contexts, costs, 64, 9), score)


def c6_regression_scores(spark, sf):
    """Scores of held-out rows' candidates by cost-sensitive regression."""
    return _candidate_scores(_regressed(spark, sf))


def c7_mlp_scores(spark, sf):
    """Scores of held-out rows' candidates by a multilayer perceptron."""
    learn, score = _parted(spark, sf)
    rows = learn.where("is_gold").select(F.col("ctx").alias("v"), "label")
    return _candidate_scores(mo.label_scores(mo.mlp_classifier(rows, 16), score))


def m12_mlp(spark, sf):
    """Held-out accuracy of a multilayer perceptron by label."""
    return _best_is_gold(c7_mlp_scores(spark, sf))


def _best_is_gold(scored):
    best = scored.groupBy("row_id").agg(F.max(F.struct("score", "tgt"))["tgt"].alias("best"), F.max(F.when(F.col("is_gold"), F.col("tgt"))).alias("gold"))
    return best.groupBy(F.col("gold").alias("label")).agg(F.count("*").alias("n"), F.avg((F.col("best") == F.col("gold")).cast("double")).alias("accuracy"))


def l14_second_order(spark, sf):
    """Second-order features of the labels' mean vectors: the halves' outer product, as printed."""
    means = label_means(px.vectors(spark, sf))
    return means.select("label", sc.second_order(F.transform(F.slice("v", 1, 32), lambda x: F.round(x, 9)), F.transform(F.slice("v", 33, 32), lambda x: F.round(x, 9))).alias("line"))


L14 = _with(SCORED + """, h AS (SELECT label, list_transform(m[1:32], lambda x: printf('%.3g', round(x, 9))::DOUBLE) AS a, list_transform(m[33:64], lambda x: printf('%.3g', round(x, 9))::DOUBLE) AS b FROM mv),
o AS (SELECT label, flatten(list_transform(a, lambda x: list_transform(b, lambda y: x * y))) AS o FROM h)
SELECT label, array_to_string(list_transform(o, lambda x, i: printf('op%d=%.3g', i - 1, x)), ' ') AS line FROM o""")


def m1_context_cca(spark, sf):
    """Left against right contexts of the occurrences: canonical correlations within the range of the whitened product."""
    features = durable(con.context_features(con.with_context(px.occurrences(spark, sf), 2)))
    sides = [features.where(F.col("side") == s) for s in "LR"]
    cells = [durable(cnt.context_matrix(f, 1)[1]) for f in sides]
    _, _, s = la.cca_tables(*cells, 5, 1.0, 1.0, most=256, alternations=0)
    return _values(spark, k=np.arange(len(s)), correlation=np.round(s, 4))


def _costs(spark, sf):
    counts = cnt.top_targets(px.counts(spark, sf), 3)
    rows = px.occurrences(spark, sf).select("row_id", "src", F.col("tgt").alias("gold"))
    cands = rows.join(counts, "src").withColumn("is_gold", F.col("tgt") == F.col("gold"))
    return cands.join(cands.where("is_gold").select("row_id"), "row_id", "left_semi")


def m8_label_costs(spark, sf):
    return mo.label_costs(_costs(spark, sf)).select("row_id", "tgt", F.col("cost").alias("cost"))


M8 = _with(""", kept AS (SELECT src, tgt, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, tgt) AS rn FROM counts) WHERE rn <= 3),
c AS (SELECT row_id, kept.tgt, n, kept.tgt = occ.tgt AS g FROM occ JOIN kept USING (src)), w AS (SELECT *, count(*) OVER p AS k, sum(n) OVER p - max(n) FILTER (g) OVER p AS rest, bool_or(g) OVER p AS has FROM c WINDOW p AS (PARTITION BY row_id))
SELECT row_id, tgt, CASE WHEN g THEN 0.0::DOUBLE ELSE round((n + 1) * k::DOUBLE / CASE WHEN rest = 0 THEN k - 1 ELSE rest END, 1) END AS cost FROM w WHERE has""")


def m9_cost_regression(spark, sf):
    """Held-out accuracy by label of cost-sensitive regression."""
    return _best_is_gold(_regressed(spark, sf))


def m10_indicators(spark, sf):
    rows = con.with_context(px.occurrences(spark, sf), 1)
    features = con.context_features(rows)
    vocab = cnt.context_vocabulary(features, 1)
    return mo.indicator_features(features.join(vocab.withColumnRenamed("type", "feature"), "feature"))


M10 = _context_sql(1) + """, feat AS (SELECT row_id, 'L' AS side, unnest(left_con) AS feature, generate_subscripts(left_con, 1) - 1 AS pos FROM ctx
  UNION ALL SELECT row_id, 'R', unnest(right_con), generate_subscripts(right_con, 1) - 1 FROM ctx),
o AS (SELECT *, row_id * 256 + CASE side WHEN 'R' THEN 128 ELSE 0 END + pos AS spot FROM feat),
vocab AS (SELECT feature, row_number() OVER (ORDER BY spot) - 1 AS id FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY spot) AS rn FROM o) WHERE rn = 2)
SELECT row_id, string_agg(DISTINCT side || id, ' ' ORDER BY side || id) AS indicators FROM feat JOIN vocab USING (feature) GROUP BY row_id"""


def m11_svm_lines(spark, sf):
    vec = px.vectors(spark, sf)
    return mo.svm_lines(vec.select(F.col("vec_id").alias("row_id"), "v"), _views(spark, sf)[2])


M11 = _with(" SELECT vec_id AS row_id, (label + 1) || ' ' || array_to_string(list_transform(v, lambda x, i: printf('%d:%.5g', i, x)), ' ') AS line FROM vec")


QUERIES = {
    "l1_cross_covariance": (l1_cross_covariance, _with(XY + " SELECT i, j, round(val, 6) AS val FROM xy")),
    "l1_context_gram": (l1_context_gram, _context_gram_sql()),
    "l2_centred_product": (l2_centred_product, L2),
    "l3_diagonal_whitening": (l3_diagonal_whitening, L3),
    "l4_ppmi": (l4_ppmi, _ppmi_sql()),
    "l5_identity_svd": (l5_identity_svd, None),
    "l6_cca": (l6_cca, None),
    "l7_ridge": (l7_ridge, None),
    "l8_randomised_svd": (l8_randomised_svd, None),
    "l9_projection": (l9_projection, L9),
    "l10_concatenated": (l10_concatenated, L10),
    "l11_back_off": (l11_back_off, L11),
    "l12_l14_vectors": (l12_l14_vectors, L12),
    "l14_second_order": (l14_second_order, L14),
    "l15_vector_sums": (l15_vector_sums, L15),
    "c5_matching_scores": (c5_matching_scores, None),
    "c6_regression_scores": (c6_regression_scores, None),
    "c7_mlp_scores": (c7_mlp_scores, None),
    "m1_context_cca": (m1_context_cca, None),
    "m2_two_step_cca": (m2_two_step_cca, None),
    "m3_glm": (m3_glm, None),
    "m4_shrinkage": (m4_shrinkage, M4),
    "m5_matching_set": (m5_matching_set, M5),
    "m6_hard_rows": (m6_hard_rows, M6),
    "m7_matching_network": (m7_matching_network, None),
    "m8_label_costs": (m8_label_costs, M8),
    "m9_cost_regression": (m9_cost_regression, None),
    "m10_indicators": (m10_indicators, M10),
    "m11_svm_lines": (m11_svm_lines, M11),
    "m12_mlp": (m12_mlp, None),
}

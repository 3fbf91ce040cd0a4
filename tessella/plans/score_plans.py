"""Queries: candidate scores, normalisation, ranking, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counting as cnt
from ..operators import evaluation as ev
from ..operators import features as feat
from ..operators import scoring as sc
from ..sources import proxies as px
from .count_plans import LONG, _rounded
from .text_plans import _with


def label_means(vectors):
    long = vectors.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def cosine_scored(spark, sf):
    """Vectors as contexts, labels' mean vectors as candidates' parameters; label 9 is in the inventory without parameters."""
    vec = px.vectors(spark, sf)
    params = label_means(vec).select(F.lit("x").alias("src"), F.col("label").cast("string").alias("tgt"), "v")
    rows = vec.select(F.col("vec_id").alias("row_id"), F.lit("x").alias("src"), F.col("v").alias("ctx"), F.col("label").cast("string").alias("gold"))
    cands = sc.candidates(rows, params.select("src", "tgt"), params.where("tgt <> '9'"))
    return cands.select("row_id", "src", "tgt", sc.cca_score(F.col("ctx"), F.col("v")).alias("score"), (F.col("tgt") == F.col("gold")).alias("is_gold"), "ctx", "v")


SCORED = LONG + """, mean AS (SELECT label, i, avg(x) AS x FROM long GROUP BY label, i),
mv AS (SELECT label, list(x ORDER BY i) AS m FROM mean GROUP BY label),
scored AS (SELECT vec_id AS row_id, mv.label::VARCHAR AS tgt, CASE WHEN mv.label <> 9 THEN list_cosine_similarity(v, m) END AS score, mv.label = vec.label AS is_gold FROM vec, mv)"""


def c1_candidates(spark, sf):
    return cosine_scored(spark, sf).groupBy("row_id").agg(F.count("*").alias("n"), F.count("score").alias("n_scored"))


C1 = _with(SCORED + " SELECT row_id, count(*) AS n, count(score) AS n_scored FROM scored GROUP BY row_id")


def c2_cca_scores(spark, sf):
    return _rounded(cosine_scored(spark, sf).select("row_id", "tgt", "score"), "score")


C2 = _with(SCORED + " SELECT row_id, tgt, round(score, 6) AS score FROM scored")


def c3_skipgram_scores(spark, sf):
    """Context of two halves of 32, parameters of 32: the labels' mean vectors' first half."""
    rows = cosine_scored(spark, sf)
    return _rounded(rows.select("row_id", "tgt", sc.skipgram_score(F.col("ctx"), F.slice("v", 1, 32), 32).alias("score")), "score")


C3 = _with(SCORED + """ SELECT vec_id AS row_id, mv.label::VARCHAR AS tgt, CASE WHEN mv.label <> 9 THEN
  round(list_cosine_similarity(list_transform(range(1, 33), lambda i: v[i] + v[i + 32]), m[1:32]), 6) END AS score FROM vec, mv""")


def c4_glm_scores(spark, sf):
    rows = cosine_scored(spark, sf)
    x = F.concat("ctx", F.array(F.lit(1.0)))
    beta = F.when(F.col("v").isNotNull(), F.concat("v", F.array(F.lit(0.5))))
    return _rounded(rows.select("row_id", "tgt", sc.glm_score(x, beta, 0.5).alias("score")), "score")


C4 = _with(SCORED + " SELECT vec_id AS row_id, mv.label::VARCHAR AS tgt, CASE WHEN mv.label <> 9 THEN round(0.5 * (list_dot_product(v, m) + 0.5), 6) END AS score FROM vec, mv")


def _channel(spark, sf):
    """Synthetic language model costs for every row and the three most frequent targets of its source."""
    occ, counts = px.occurrences(spark, sf), px.counts(spark, sf)
    kept = cnt.top_targets(counts, 3)
    rows = occ.select("row_id", "src", F.col("tgt").alias("gold"))
    cost = (1 + (F.col("row_id") + F.length("tgt") * 3) % 11) / 4
    lm = rows.join(kept.select("src", "tgt"), "src").select("row_id", "tgt", cost.alias("score"))
    return sc.source_channel(lm, feat.relative_frequencies(counts), rows).join(rows.select("row_id", "gold"), "row_id").withColumn("is_gold", F.col("tgt") == F.col("gold"))


CHANNEL = """, freq AS (SELECT src, tgt, log10(n::DOUBLE / sum(n) OVER (PARTITION BY src)) AS ef, log10(n::DOUBLE / sum(n) OVER (PARTITION BY tgt)) AS fe FROM counts),
kept AS (SELECT src, tgt FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, tgt) AS rn FROM counts) WHERE rn <= 3),
cand AS (SELECT row_id, occ.src, kept.tgt, occ.tgt AS gold, -(1 + (row_id + length(kept.tgt) * 3) % 11)::DOUBLE / 4 AS lm, ef, fe FROM occ JOIN kept ON kept.src = occ.src JOIN freq ON freq.src = occ.src AND freq.tgt = kept.tgt),
channel AS (
  SELECT row_id, src, tgt, gold, 'lm' AS variant, lm AS score FROM cand UNION ALL SELECT row_id, src, tgt, gold, 'e_f', ef FROM cand
  UNION ALL SELECT row_id, src, tgt, gold, 'lm_e_f', lm + ef FROM cand UNION ALL SELECT row_id, src, tgt, gold, 'f_e', fe FROM cand
  UNION ALL SELECT row_id, src, tgt, gold, 'lm_f_e', lm + fe FROM cand
)"""


def c8_source_channel(spark, sf):
    return _rounded(_channel(spark, sf).select("row_id", "src", "tgt", "variant", "score"), "score")


C8 = _with(CHANNEL + " SELECT row_id, src, tgt, variant, round(score, 6) AS score FROM channel")


def c9_softmax(spark, sf):
    rows = cosine_scored(spark, sf)
    return _rounded(rows.select("row_id", "tgt", sc.softmax(F.col("score"), ["row_id"]).alias("p")), "p")


C9 = _with(SCORED + " SELECT row_id, tgt, round(exp(score) / sum(exp(score)) OVER (PARTITION BY row_id), 6) AS p FROM scored")


def c10_range(spark, sf):
    rows, s = cosine_scored(spark, sf), F.col("score")
    return _rounded(
        rows.select("row_id", "tgt", sc.range_normalised(s, ["row_id"]).alias("r"), sc.range_normalised(s, ["row_id"], True).alias("r_pos"), sc.range_normalised(s, ["row_id"], True, True).alias("r_log")), "r", "r_pos", "r_log"
    )


C10 = _with(SCORED + """, a AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, avg(score) OVER w AS me, count(score) OVER w AS k FROM scored WINDOW w AS (PARTITION BY row_id))
SELECT row_id, tgt, round(CASE WHEN hi = lo THEN 1.0 / k ELSE (score - me) / (hi - lo) END, 6) AS r,
  round(CASE WHEN hi = lo THEN 1.0 / k ELSE (score - lo) / (hi - lo) END, 6) AS r_pos, round(CASE WHEN hi = lo THEN 1.0 / k ELSE (score - lo) / (hi - lo) + 1 END, 6) AS r_log FROM a""")


def c11_c12_angular_log(spark, sf):
    rows = cosine_scored(spark, sf)
    a = sc.angular(F.col("score"))
    return _rounded(rows.select("row_id", "tgt", F.when(F.col("score").isNotNull(), a).alias("ang"), F.when(F.col("score").isNotNull(), sc.log_score(a)).alias("lg")), "ang", "lg")


C11 = _with(SCORED + """, a AS (SELECT row_id, tgt, 1 - acos(least(1.0, greatest(-1.0, score))) / pi() AS ang, score FROM scored)
SELECT row_id, tgt, CASE WHEN score IS NOT NULL THEN round(ang, 6) END AS ang, CASE WHEN score IS NOT NULL THEN round(-log10(ang), 6) END AS lg FROM a""")


def c13_c16_flags(spark, sf):
    rows = cosine_scored(spark, sf).select("row_id", "tgt", "score")
    out = sc.post_processed(rows, ["row_id"], normalise="exp", rank=True)
    return _rounded(out.select("row_id", "tgt", "rank", F.col("shown").alias("recip"), "best", "off", "logit"), "recip", "logit")


C13 = _with(SCORED + """, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC NULLS LAST, tgt) AS rk FROM scored)
SELECT row_id, tgt, rk::INT AS rank, CASE WHEN score IS NOT NULL THEN round(1.0::DOUBLE / rk, 6) END AS recip, (rk = 1 AND score IS NOT NULL)::INT AS best,
  (score IS NULL)::INT AS off, CASE WHEN score IS NOT NULL THEN round(1 / (1 + exp(-(1.0::DOUBLE / rk))), 6) END AS logit FROM r""")


def c17_representations(spark, sf):
    vec = px.vectors(spark, sf)
    return vec.select("vec_id", sc.representation("con", F.col("v")).alias("rep"))


C17 = _with(" SELECT vec_id, array_to_string(list_transform(v, lambda x, i: printf('con_dim%d=%.3g', i - 1, x)), ' ') AS rep FROM vec")


def c18_sign_buckets(spark, sf):
    vec = px.vectors(spark, sf)
    return cnt.sign_buckets(vec, cnt.sign_means(vec), "vec_id")


C18 = _with(LONG + """, m AS (SELECT i, coalesce(avg(x) FILTER (x > 0), 0) AS p, coalesce(avg(x) FILTER (x < 0), 0) AS n FROM long GROUP BY i)
SELECT vec_id, i::INT AS i, CASE WHEN x > 0 THEN x > p ELSE x < n END::INT AS bucket FROM long JOIN m USING (i)""")


def c19_order(spark, sf):
    """Scores equal up to rounding (log10 of a tenth and of one, with costs one apart) are ties."""
    rows = _channel(spark, sf).where("variant = 'lm_f_e'").select("row_id", "tgt", F.round("score", 12).alias("score"))
    return rows.withColumn("place", F.row_number().over(sc.ordered(["row_id"]))).select("row_id", "tgt", "place")


C19 = _with(CHANNEL + " SELECT row_id, tgt, row_number() OVER (PARTITION BY row_id ORDER BY round(score, 12) DESC NULLS LAST, tgt)::INT AS place FROM channel WHERE variant = 'lm_f_e'")


def c20_rule_lines(spark, sf):
    rows = cosine_scored(spark, sf).select("row_id", F.lit("[X]").alias("lhs"), "src", "tgt", "score")
    out = sc.rule_line(sc.post_processed(rows, ["row_id"], rank=True), best=True)
    return out.select("row_id", "line").distinct()


C20 = _with(SCORED + """, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC NULLS LAST, tgt) AS rk FROM scored)
SELECT DISTINCT row_id, '[X] ||| x ||| ' || tgt || ' ||| ' || CASE WHEN score IS NULL THEN 'cca_off=1' ELSE printf('cca_on=1 cca_score=%.5g', 1.0::DOUBLE / rk) || CASE WHEN rk = 1 THEN ' cca_best=1' ELSE '' END END AS line FROM r""")


def _pair_ids(spark, sf):
    return cnt.pair_vocabulary(px.occurrences(spark, sf), 1, unknown=True)[1]


def e1_scorable(spark, sf):
    return ev.scorable(px.occurrences(spark, sf), _pair_ids(spark, sf)).select("row_id")


E1 = _with(" SELECT row_id FROM occ JOIN counts USING (src, tgt) WHERE n > 1")


def e2_e5_report(spark, sf):
    out = ev.report(ev.gold_ranks(cosine_scored(spark, sf)))
    return _rounded(out, "mrr", "hard_mrr", "mse", "mean_cands")


REPORT = """round(avg(1.0::DOUBLE / rk), 6) AS mrr, round(avg(1.0::DOUBLE / rk) FILTER (rk > 1), 6) AS hard_mrr, count(*) FILTER (rk > 1) AS n_hard,
  round(avg((1 - score) * (1 - score)), 6) AS mse, round(sum(k)::DOUBLE / count(rk), 6) AS mean_cands, count(rk) AS n_scored"""
E2 = _with(SCORED + f""", r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC NULLS LAST, tgt) AS place, count(*) OVER (PARTITION BY row_id) AS k FROM scored),
g AS (SELECT row_id, k, CASE WHEN score IS NOT NULL THEN place END AS rk, score FROM r WHERE is_gold AND k > 1) SELECT {REPORT} FROM g""")


def e6_channel_report(spark, sf):
    scored = _channel(spark, sf).withColumn("key", F.concat_ws(":", "row_id", "variant")).withColumn("score", F.round("score", 9))
    ranks = ev.gold_ranks(scored, "key").withColumn("variant", F.element_at(F.split("key", ":"), 2))
    return _rounded(ev.report(ranks, ["variant"]), "mrr", "hard_mrr", "mse", "mean_cands")


E6 = _with(CHANNEL + f""", r AS (SELECT *, row_number() OVER (PARTITION BY row_id, variant ORDER BY round(score, 9) DESC, tgt) AS place, count(*) OVER (PARTITION BY row_id, variant) AS k FROM channel),
g AS (SELECT row_id, variant, any_value(k) AS k, max(place) FILTER (tgt = gold) AS rk, max(round(score, 9)) FILTER (tgt = gold) AS score FROM r WHERE k > 1 GROUP BY row_id, variant)
SELECT variant, {REPORT} FROM g GROUP BY variant""")

QUERIES = {
    "c1_candidates": (c1_candidates, C1),
    "c2_cca_scores": (c2_cca_scores, C2),
    "c3_skipgram_scores": (c3_skipgram_scores, C3),
    "c4_glm_scores": (c4_glm_scores, C4),
    "c8_source_channel": (c8_source_channel, C8),
    "c9_softmax": (c9_softmax, C9),
    "c10_range": (c10_range, C10),
    "c11_c12_angular_log": (c11_c12_angular_log, C11),
    "c13_c16_flags": (c13_c16_flags, C13),
    "c17_representations": (c17_representations, C17),
    "c18_sign_buckets": (c18_sign_buckets, C18),
    "c19_order": (c19_order, C19),
    "c20_rule_lines": (c20_rule_lines, C20),
    "e1_scorable": (e1_scorable, E1),
    "e2_e5_report": (e2_e5_report, E2),
    "e6_channel_report": (e6_channel_report, E6),
}

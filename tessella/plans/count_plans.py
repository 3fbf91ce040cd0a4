"""Queries: counts, vocabularies, sparse matrices, relative frequencies, grammar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as con
from ..operators import counting as cnt
from ..operators import features as feat
from ..sources import proxies as px
from .text_plans import _context_sql, _with


def a1_pair_counts(spark, sf):
    return px.counts(spark, sf)


A1 = _with(" SELECT src, tgt, n FROM counts")


def a2_reverse_counts(spark, sf):
    return px.counts(spark, sf).groupBy("tgt").agg(F.count("*").alias("n_src"), F.sum("n").alias("n"))


A2 = _with(" SELECT tgt, count(*) AS n_src, sum(n)::BIGINT AS n FROM counts GROUP BY tgt")


def a3_top_targets(spark, sf):
    return cnt.top_targets(px.counts(spark, sf), 3)


RANKED = ", r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, tgt) AS rn FROM counts)"
A3 = _with(RANKED + " SELECT src, tgt, n FROM r WHERE rn <= 3")


def a4_excluded_pairs(spark, sf):
    return cnt.excluded_pairs(px.counts(spark, sf), 3)


A4 = _with(RANKED + " SELECT src, tgt, n FROM r WHERE rn > 3")


def item_counts(spark, sf):
    """Pairs of the largest table: parts as sources, suppliers as targets."""
    return cnt.pair_counts(px.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("tgt")))


ITEMS = "WITH counts AS (SELECT l_partkey AS src, l_suppkey AS tgt, count(*) AS n FROM lineitem GROUP BY ALL)"


def a3_top_items(spark, sf):
    return cnt.top_targets(item_counts(spark, sf), 2)


def f1_item_frequencies(spark, sf):
    return _rounded(feat.relative_frequencies(item_counts(spark, sf)), "log_e_f", "log_f_e")


def a5_distinct_pairs(spark, sf):
    return px.phrase_pairs(spark, sf).select("src", "tgt").distinct()


A5 = _with(" SELECT DISTINCT src, tgt FROM pp")


def _source_words(spark, sf):
    return px.occurrences(spark, sf).select("row_id", F.col("src").alias("word"))


def a6_vocabulary(spark, sf):
    return cnt.vocabulary(_source_words(spark, sf), 1, "word", "row_id")


A6 = _with(""", t AS (SELECT src AS type, row_id, row_number() OVER (PARTITION BY src ORDER BY row_id) AS rn FROM occ)
SELECT type, row_number() OVER (ORDER BY row_id) - 1 AS id FROM t WHERE rn = 2""")


def _features(spark, sf):
    return con.context_features(con.with_context(px.occurrences(spark, sf), 2))


FEAT = """, feat AS (
  SELECT row_id, 'L' AS side, unnest(left_con) AS feature, generate_subscripts(left_con, 1) - 1 AS pos FROM ctx
  UNION ALL SELECT row_id, 'R', unnest(right_con), generate_subscripts(right_con, 1) - 1 FROM ctx
), placed AS (SELECT *, row_id * 256 + CASE side WHEN 'R' THEN 128 ELSE 0 END + pos AS spot FROM feat),
vocab AS (
  SELECT feature AS type, row_number() OVER (ORDER BY spot) - 1 AS id
  FROM (SELECT feature, spot, row_number() OVER (PARTITION BY feature ORDER BY spot) AS rn FROM placed) WHERE rn = 2
)"""


def a7_context_vocabulary(spark, sf):
    return cnt.context_vocabulary(_features(spark, sf), 1)


A7 = _context_sql(2) + FEAT + " SELECT type, id FROM vocab"


def a8_pair_columns(spark, sf):
    rows = px.occurrences(spark, sf)
    out = cnt.excluded_pairs(px.counts(spark, sf), 3)
    return cnt.pair_vocabulary(rows, 1, out, unknown=True)[1]


A8 = _with(RANKED + """, k AS (SELECT occ.* FROM occ JOIN r USING (src, tgt) WHERE rn <= 3),
t AS (SELECT src, tgt, row_id, row_number() OVER (PARTITION BY src, tgt ORDER BY row_id) AS o FROM k),
v AS (SELECT src, tgt, row_number() OVER (ORDER BY row_id) AS id FROM t WHERE o = 2)
SELECT row_id, coalesce(id, 0) AS id FROM occ LEFT JOIN v USING (src, tgt)""")


def a9_unknown_columns(spark, sf):
    rows = con.with_context(px.occurrences(spark, sf), 2, position=True)
    vocab, cells = cnt.context_matrix(con.context_features(rows), 1, position=True)
    named = cells.join(vocab, "id").where(F.col("type").startswith("<unk>"))
    return named.groupBy("type").agg(F.sum("val").alias("total"))


A9 = _context_sql(2, position=True) + FEAT + """
SELECT '<unk>' || regexp_extract(feature, '(_dist[0-9]+)$', 1) AS type, count(*)::DOUBLE AS total FROM placed WHERE feature NOT IN (SELECT type FROM vocab) GROUP BY ALL"""


def a10_cells(spark, sf):
    return cnt.context_matrix(_features(spark, sf), 1)[1]


CELLS = FEAT + """, names AS (SELECT row_id, CASE WHEN feature IN (SELECT type FROM vocab) THEN feature ELSE '<unk>' END AS type FROM placed),
whole AS (SELECT * FROM vocab UNION ALL SELECT '<unk>', (SELECT count(*) FROM vocab)),
cells AS (SELECT row_id, id, count(*)::DOUBLE AS val FROM names JOIN whole USING (type) GROUP BY row_id, id)"""
A10 = _context_sql(2) + CELLS + " SELECT row_id, id, val FROM cells"


def a11_centred(spark, sf):
    out = cnt.centred(px.vectors(spark, sf), "vec_id")
    return out.select("vec_id", "i", F.round("x", 6).alias("x"))


LONG = ", long AS (SELECT vec_id, label, i - 1 AS i, v[i] AS x FROM vec, range(1, 65) t(i))"
A11 = _with(LONG + " SELECT vec_id, i::INT AS i, round(x - avg(x) OVER (PARTITION BY i), 6) AS x FROM long")


def _pair_cells(spark, sf):
    _, ids = cnt.pair_vocabulary(px.occurrences(spark, sf), 1)
    return ids.withColumn("val", F.lit(1.0))


def a12_non_empty_rows(spark, sf):
    cells = cnt.context_matrix(_features(spark, sf), 1)[1]
    out = cnt.without_empty_rows(cells, _pair_cells(spark, sf))
    return out.groupBy("row_id", "new_row").agg(F.sum("val").alias("total"))


PAIRS = """, pv AS (SELECT src, tgt FROM counts WHERE n > 1), filled AS (SELECT row_id FROM occ JOIN pv USING (src, tgt))"""
A12 = _context_sql(2) + CELLS + PAIRS + """ SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS new_row, sum(val) AS total FROM cells WHERE row_id IN (SELECT row_id FROM filled) GROUP BY row_id"""


def a13_row_subset(spark, sf):
    cells = cnt.context_matrix(_features(spark, sf), 1)[1]
    return cnt.row_subset(cells, _pair_cells(spark, sf))


A13 = _context_sql(2) + CELLS + PAIRS + " SELECT row_id, id, val FROM cells WHERE row_id IN (SELECT row_id FROM filled)"


def a14_held_out(spark, sf):
    return cnt.held_out(px.occurrences(spark, sf).select("row_id"), 0.1)


A14 = _with(""", n AS (SELECT count(*) AS n FROM occ),
h AS (SELECT row_id, row_number() OVER (ORDER BY md5(row_id || ':42'), row_id) AS place FROM occ) SELECT row_id FROM h, n WHERE place <= floor(n * 0.1)""")


def a15_column_sums(spark, sf):
    return cnt.column_sums(cnt.context_matrix(_features(spark, sf), 1)[1])


A15 = _context_sql(2) + CELLS + " SELECT id, sum(val) AS total FROM cells GROUP BY id"


def a16_sign_means(spark, sf):
    out = cnt.sign_means(px.vectors(spark, sf))
    return out.select("i", F.round("pos_mean", 6).alias("pos_mean"), F.round("neg_mean", 6).alias("neg_mean"))


A16 = _with(LONG + " SELECT i::INT AS i, round(coalesce(avg(x) FILTER (x > 0), 0), 6) AS pos_mean, round(coalesce(avg(x) FILTER (x < 0), 0), 6) AS neg_mean FROM long GROUP BY i")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def f1_f2_relative_frequencies(spark, sf):
    return _rounded(feat.relative_frequencies(px.counts(spark, sf)), "log_e_f", "log_f_e")


SHARES = """ SELECT src, tgt, n, round(log10(n::DOUBLE / sum(n) OVER (PARTITION BY src)), 6) AS log_e_f, round(log10(n::DOUBLE / sum(n) OVER (PARTITION BY tgt)), 6) AS log_f_e FROM counts"""


def f3_f6_rule_features(spark, sf):
    return _rounded(feat.rule_features(px.counts(spark, sf)), "e_given_f", "sample_count_f", "count_ef")


def f4_f5_without_add_one(spark, sf):
    out = feat.rule_features(px.counts(spark, sf), add_one=False).select("src", "tgt", "sample_count_f", "count_ef")
    return _rounded(out, "sample_count_f", "count_ef")


F4 = _with(" SELECT src, tgt, round(log10(sum(n) OVER (PARTITION BY src)), 6) AS sample_count_f, round(log10(n), 6) AS count_ef FROM counts")

RULES = """, totals AS (SELECT src, sum(n) AS total, count(*) AS types FROM counts GROUP BY src),
rules AS (SELECT src, tgt, -log10(n::DOUBLE / total) AS e_given_f, log10(total + types) AS sample_count_f, log10(n + 1) AS count_ef,
  (total = 1)::INT AS is_singleton_f, (n = 1)::INT AS is_singleton_fe FROM counts JOIN totals USING (src))"""
F3 = _with(RULES + " SELECT src, tgt, round(e_given_f, 6) AS e_given_f, round(sample_count_f, 6) AS sample_count_f, round(count_ef, 6) AS count_ef, is_singleton_f, is_singleton_fe FROM rules")


def _two_word_pairs(spark, sf):
    """Adjacent lexical pairs joined to phrases of two words each."""
    p = px.phrase_pairs(spark, sf)
    nxt = p.select("sent_id", (F.col("ord") - 1).alias("ord"), F.col("src").alias("src2"), F.col("tgt").alias("tgt2"))
    return p.join(nxt, ["sent_id", "ord"]).select(F.concat_ws(" ", "src", "src2").alias("src"), F.concat_ws(" ", "tgt", "tgt2").alias("tgt"))


def f7_f8_lexical_features(spark, sf):
    out = feat.lexical_features(_two_word_pairs(spark, sf), feat.lexical_table(px.counts(spark, sf)))
    return _rounded(out, "max_lex_e_f", "max_lex_f_e")


F7 = _with(""", tt AS (SELECT src AS f, tgt AS e, n::DOUBLE / sum(n) OVER (PARTITION BY src) AS p_ef, n::DOUBLE / sum(n) OVER (PARTITION BY tgt) AS p_fe FROM counts),
two AS (SELECT DISTINCT a.src || ' ' || b.src AS src, a.tgt || ' ' || b.tgt AS tgt FROM pp a JOIN pp b ON a.sent_id = b.sent_id AND b.ord = a.ord + 1),
sp AS (SELECT src, tgt, string_split(src, ' ') AS fs, string_split(tgt, ' ') AS es FROM two),
e1 AS (SELECT src, tgt, k, max(p_ef) AS p FROM (SELECT src, tgt, fs, unnest(es) AS e, generate_subscripts(es, 1) AS k FROM sp) x LEFT JOIN tt ON tt.e = x.e AND list_contains(x.fs, tt.f) GROUP BY src, tgt, k),
f1 AS (SELECT src, tgt, k, max(p_fe) AS p FROM (SELECT src, tgt, es, unnest(fs) AS f, generate_subscripts(fs, 1) AS k FROM sp) x LEFT JOIN tt ON tt.f = x.f AND list_contains(x.es, tt.e) GROUP BY src, tgt, k),
e2 AS (SELECT src, tgt, sum(coalesce(-log10(p), 99)) AS v FROM e1 GROUP BY src, tgt),
f2 AS (SELECT src, tgt, sum(coalesce(-log10(p), 99)) AS v FROM f1 GROUP BY src, tgt)
SELECT src, tgt, CASE WHEN e2.v < 99 THEN round(e2.v, 6) END AS max_lex_e_f, CASE WHEN f2.v < 99 THEN round(f2.v, 6) END AS max_lex_f_e FROM e2 JOIN f2 USING (src, tgt)""")


def _grammar_rules(spark, sf):
    """Lines as decoders emit them: phrase rules, rules with a non-terminal, unknown words, copies."""
    pairs = px.phrase_pairs(spark, sf)
    kind = F.col("ord") % 7
    nt = F.when(kind == 3, F.lit(" [X_0_1]")).otherwise(F.lit(""))
    return pairs.select(
        "sent_id", "ord", F.lit("[X]").alias("lhs"), F.when(kind == 5, F.lit("<unk>")).otherwise(F.concat("src", nt)).alias("src"), F.concat("tgt", nt).alias("tgt"),
        F.when(kind.isin(0, 5), "PassThrough=1").otherwise("f=1").alias("features"),
    )


LINES = RULES + """, g AS (SELECT sent_id, ord, CASE WHEN ord % 7 = 5 THEN '<unk>' WHEN ord % 7 = 3 THEN src || ' [X_0_1]' ELSE src END AS src,
  CASE WHEN ord % 7 = 3 THEN tgt || ' [X_0_1]' ELSE tgt END AS tgt, CASE WHEN ord % 7 IN (0, 5) THEN 'PassThrough=1' ELSE 'f=1' END AS features FROM pp),
w AS (SELECT sent_id, ord, src = '<unk>' AS unk, CASE WHEN src = '<unk>' THEN tgt ELSE src END AS src, tgt, features, src || tgt LIKE '%[%]%' AS nt FROM g),
k AS (SELECT w.*, CASE WHEN NOT unk AND NOT nt AND features <> 'PassThrough=1' AND is_singleton_f IS NOT NULL THEN
  CASE WHEN e_given_f = 0 THEN ' EgivenF=-0.0' ELSE printf(' EgivenF=%.11f', e_given_f) END ||
  printf(' SampleCountF=%.11f CountEF=%.11f IsSingletonF=%d IsSingletonFE=%d', sample_count_f, count_ef, is_singleton_f, is_singleton_fe) ELSE '' END AS counted FROM w LEFT JOIN rules USING (src, tgt))"""


def f10_featurised_rules(spark, sf):
    return feat.featurised_rules(_grammar_rules(spark, sf), px.counts(spark, sf)).select("sent_id", "line")


F10 = _with(LINES + " SELECT sent_id, '[X] ||| ' || src || ' ||| ' || tgt || ' ||| ' || features || counted AS line FROM k")


def f9_lexical_rules(spark, sf):
    """The same lines with lexical features, of a table in which frequent words also come of nothing (``NULL``)."""
    counts = px.counts(spark, sf)
    table = feat.lexical_table(counts).select("f", "e", F.round("p_ef", 9).alias("p_ef"), F.round("p_fe", 9).alias("p_fe"))
    loose = counts.groupBy("tgt").agg(F.sum("n").alias("n")).where("n > 20").select(F.lit("NULL").alias("f"), F.col("tgt").alias("e"), F.lit(0.05).alias("p_ef"), F.lit(0.0).alias("p_fe"))
    return feat.featurised_rules(_grammar_rules(spark, sf), counts, table.unionByName(loose)).select("sent_id", "line")


F9 = _with(LINES + """, tt AS (SELECT src AS f, tgt AS e, round(n::DOUBLE / sum(n) OVER (PARTITION BY src), 9) AS p_ef, round(n::DOUBLE / sum(n) OVER (PARTITION BY tgt), 9) AS p_fe FROM counts
  UNION ALL SELECT 'NULL', tgt, 0.05, 0.0 FROM counts GROUP BY tgt HAVING sum(n) > 20),
u AS (SELECT DISTINCT src, tgt, string_split(src, ' ') AS fs, string_split(tgt, ' ') AS es FROM k WHERE features <> 'PassThrough=1'),
fe AS (SELECT src, tgt, i, max(p_fe) AS p FROM (SELECT src, tgt, es, unnest(fs) AS f, generate_subscripts(fs, 1) AS i FROM u) x LEFT JOIN tt ON tt.f = x.f AND list_contains(list_append(x.es, 'NULL'), tt.e) GROUP BY ALL),
ef AS (SELECT src, tgt, i, max(p_ef) AS p FROM (SELECT src, tgt, fs, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM u) x LEFT JOIN tt ON tt.e = x.e AND list_contains(list_append(x.fs, 'NULL'), tt.f) GROUP BY ALL),
a AS (SELECT src, tgt, sum(CASE WHEN p > 0 THEN -log10(p) ELSE 99 END) AS v FROM fe GROUP BY ALL), b AS (SELECT src, tgt, sum(CASE WHEN p > 0 THEN -log10(p) ELSE 99 END) AS v FROM ef GROUP BY ALL)
SELECT sent_id, '[X] ||| ' || k.src || ' ||| ' || k.tgt || ' ||| ' || features || counted ||
  CASE WHEN features <> 'PassThrough=1' AND a.v < 99 THEN printf(' MaxLexFgivenE=%.11f', a.v + 0.0) ELSE '' END ||
  CASE WHEN features <> 'PassThrough=1' AND b.v < 99 THEN printf(' MaxLexEgivenF=%.11f', b.v + 0.0) ELSE '' END AS line
FROM k LEFT JOIN a ON a.src = k.src AND a.tgt = k.tgt LEFT JOIN b ON b.src = k.src AND b.tgt = k.tgt""")


def f11_filtered_rules(spark, sf):
    return feat.filtered_rules(px.phrase_pairs(spark, sf), px.counts(spark, sf), 2).select("sent_id", "ord", "src", "tgt")


F11 = _with(RANKED + " SELECT sent_id, ord::INT AS ord, src, tgt FROM pp JOIN r USING (src, tgt) WHERE rn <= 2")

QUERIES = {
    "a1_pair_counts": (a1_pair_counts, A1),
    "a2_reverse_counts": (a2_reverse_counts, A2),
    "a3_top_targets": (a3_top_targets, A3),
    "a3_top_items": (a3_top_items, ITEMS + RANKED + " SELECT src, tgt, n FROM r WHERE rn <= 2"),
    "a4_excluded_pairs": (a4_excluded_pairs, A4),
    "a5_distinct_pairs": (a5_distinct_pairs, A5),
    "a6_vocabulary": (a6_vocabulary, A6),
    "a7_context_vocabulary": (a7_context_vocabulary, A7),
    "a8_pair_columns": (a8_pair_columns, A8),
    "a9_unknown_columns": (a9_unknown_columns, A9),
    "a10_cells": (a10_cells, A10),
    "a11_centred": (a11_centred, A11),
    "a12_non_empty_rows": (a12_non_empty_rows, A12),
    "a13_row_subset": (a13_row_subset, A13),
    "a14_held_out": (a14_held_out, A14),
    "a15_column_sums": (a15_column_sums, A15),
    "a16_sign_means": (a16_sign_means, A16),
    "f1_f2_relative_frequencies": (f1_f2_relative_frequencies, _with(SHARES)),
    "f1_item_frequencies": (f1_item_frequencies, ITEMS + SHARES),
    "f3_f6_rule_features": (f3_f6_rule_features, F3),
    "f4_f5_without_add_one": (f4_f5_without_add_one, F4),
    "f7_f8_lexical_features": (f7_f8_lexical_features, F7),
    "f9_lexical_rules": (f9_lexical_rules, F9),
    "f10_featurised_rules": (f10_featurised_rules, F10),
    "f11_filtered_rules": (f11_filtered_rules, F11),
}

"""Queries: sources, sinks, tokens, context windows, rule extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import bracketed, fields, pair_key, tree_leaves
from ..operators import context as con
from ..operators.counting import top_targets
from ..operators.extraction import lexical_pairs, tree_pairs
from ..operators.scoring import lm_scores
from ..session import durable
from ..sources import proxies as px
from ..sources.sinks import libsvm_line, merged_grammar, sgml_segment, sparse_line


def _with(body: str) -> str:
    return "WITH " + px.SQL.strip() + body


def s1_corpus(spark, sf):
    return px.corpus(spark, sf).select("sent_id", F.array_join("src", " ").alias("src"), F.array_join("tgt", " ").alias("tgt"))


S1 = _with(" SELECT sent_id, array_to_string(src, ' ') AS src, array_to_string(tgt, ' ') AS tgt FROM corpus")


def s4_alignments(spark, sf):
    return px.alignments(px.corpus(spark, sf)).select("sent_id", "ord", "s", "t")


S4 = _with(" SELECT sent_id, ord::INT AS ord, s::INT AS s, t::INT AS t FROM align")


def s5_unit_vectors(spark, sf):
    """Vector lines as text, read back: more than two fields, unit length; reported by norm and first value."""
    from ..functions.vectors import norm
    from ..sources.text import vectors_of

    lines = px.vectors(spark, sf).select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.transform("v", lambda x: x.cast("string")), " ")).alias("value"))
    return vectors_of(lines).select("key", F.round(norm(F.col("v")), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


S5 = _with(" SELECT vec_id::VARCHAR AS key, round(sqrt(list_sum(list_transform(v, lambda x: x * x))) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM vec")


def _lm_lines(occ):
    """Score lines from occurrences: every fifth closes a group, the rest are synthetic negative log-probabilities."""
    value = F.when(F.col("row_id") % 5 == 0, 0.0).otherwise(-(1.0 + F.col("row_id") % 7))
    return occ.select(F.col("row_id").alias("n"), value.alias("value"), "tgt", (1 + F.col("row_id") % 3).alias("n_words"))


def s8_lm_groups(spark, sf):
    out = lm_scores(_lm_lines(px.occurrences(spark, sf)))
    return out.select("row_id", "tgt", F.round("score", 6).alias("score"))


S8 = _with(""", lines AS (
  SELECT row_id AS n, CASE WHEN row_id % 5 = 0 THEN 0.0 ELSE -(1.0 + row_id % 7) END AS value, tgt, 1 + row_id % 3 AS n_words FROM occ
), g AS (
  SELECT *, coalesce(sum(CASE WHEN value >= 0 THEN 1 ELSE 0 END) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_id FROM lines
) SELECT row_id, tgt, round(arg_max(-value::DOUBLE / n_words, n), 6) AS score FROM g WHERE value < 0 GROUP BY row_id, tgt""")


def s13_merged_grammar(spark, sf):
    rules = px.phrase_pairs(spark, sf).select("sent_id", F.concat(F.lit("[X] ||| "), "src", F.lit(" ||| "), "tgt", F.lit(" ||| ")).alias("line"))
    return merged_grammar(rules)


S13 = _with(""" SELECT DISTINCT '[X] ||| ' || src || ' ||| ' || tgt || ' ||| ' AS line FROM pp UNION SELECT '[X] ||| [X,1] [X,2] ||| [1] [2] ||| Glue=1'
UNION SELECT '[X] ||| [X,1] [X,2] ||| [2] [1] ||| Glue=1 Inverse=1' UNION SELECT '[S] ||| [X,1] ||| [1] ||| 0'""")


def s14_sgml(spark, sf):
    c = px.corpus(spark, sf)
    return c.select("sent_id", sgml_segment(F.col("sent_id"), F.array_join("src", " "), F.array_join("tgt", " "), "grammars").alias("line"))


S14 = _with(""" SELECT sent_id, '<seg grammar="grammars/grammar.' || sent_id || '.gz" id="' || sent_id || '">' || array_to_string(src, ' ') || ' ||| ' || array_to_string(tgt, ' ') || '</seg>' AS line FROM corpus""")


def s15_training_lines(spark, sf):
    rows = px.vectors(spark, sf).select("vec_id", "label", F.transform("v", lambda x: F.floor(x * 1000).cast("int")).alias("q"))
    ids = F.sequence(F.lit(0), F.size("q") - 1)
    return rows.select("vec_id", sparse_line(F.col("label"), ids, F.col("q")).alias("vw"), libsvm_line(F.col("label"), ids, F.col("q")).alias("svm"))


S15 = _with(""", q AS (SELECT vec_id, label, list_transform(v, lambda x: floor(x * 1000)::INT) AS q FROM vec)
SELECT vec_id, label || ' | ' || array_to_string(list_transform(q, lambda x, i: (i - 1) || ':' || x), ' ') AS vw,
  label || ' ' || array_to_string(list_transform(q, lambda x, i: i || ':' || x), ' ') AS svm FROM q""")


def p1_tokens(spark, sf):
    from ..functions.text import tokens

    docs = px.read(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").alias("n_tokens"), F.try_element_at("w", F.lit(1)).alias("first"), F.try_element_at("w", F.lit(-1)).alias("last"))


P1 = """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, len(w)::INT AS n_tokens, w[1] AS first, w[-1] AS last FROM t"""


def p2_pair_key(spark, sf):
    return px.phrase_pairs(spark, sf).groupBy(pair_key(F.col("src"), F.col("tgt")).alias("pair")).agg(F.count("*").alias("n"))


P2 = _with(" SELECT src || ' ||| ' || tgt AS pair, count(*) AS n FROM pp GROUP BY ALL")


def _windows(rows):
    return rows.select("row_id", F.array_join("left_con", " ").alias("left_con"), F.array_join("right_con", " ").alias("right_con"))


def _context_sql(c: int, stop: str = "[]", frequent: str = "", position: bool = False) -> str:
    def side(words: str, distance: str) -> str:
        out = f"list_transform({words}, lambda w, i: {{'w': w, 'k': {distance}}})"
        out = f"list_filter({out}, lambda p: NOT list_contains({stop}::VARCHAR[], p.w))"
        word = f"CASE WHEN list_contains({frequent}, p.w) THEN p.w ELSE '<OTHER>' END" if frequent else "p.w"
        return f"list_transform({out}, lambda p: {word}" + (" || '_dist' || p.k)" if position else ")")

    left, right = f"words[greatest(l - {c}, 0) + 1 : l]", f"words[r + 2 : r + 1 + {c}]"
    return _with(f""", ctx AS (SELECT occ.*,
  list_concat(CASE WHEN l - {c} < 0 THEN ['<s>'] ELSE []::VARCHAR[] END, {side(left, f"len({left}) + 1 - i")}) AS left_con,
  list_concat({side(right, "i")}, CASE WHEN r + {c} >= len(words) THEN ['</s>'] ELSE []::VARCHAR[] END) AS right_con FROM occ)""")


SHOWN = " SELECT row_id, array_to_string(left_con, ' ') AS left_con, array_to_string(right_con, ' ') AS right_con FROM ctx"
STOP = ["the", "of", "and", "a", "to"]
FREQUENT = ["the", "of", "and", "to", "in", "that", "is", "for"]


def _array(words):
    return F.array(*[F.lit(w) for w in words])


def p3_context(spark, sf):
    return _windows(con.with_context(px.occurrences(spark, sf), 2))


def p4_stop_words(spark, sf):
    return _windows(con.with_context(px.occurrences(spark, sf), 2, stop=_array(STOP)))


def p5_frequent_words(spark, sf):
    return _windows(con.with_context(px.occurrences(spark, sf), 2, frequent=_array(FREQUENT)))


def p6_positions(spark, sf):
    return _windows(con.with_context(px.occurrences(spark, sf), 2, stop=_array(STOP), position=True))


def p11_both_sides(spark, sf):
    return _windows(con.both_sides(con.with_context(px.occurrences(spark, sf), 1, stop=_array(STOP))))


def word_vectors(spark, sf):
    """A dictionary: the word that comes n-th in the alphabet has the vector number n modulo their count."""
    from ..functions.numbering import dense_index

    vec = px.vectors(spark, sf).select("vec_id", "v")
    n = vec.agg(F.count("*").alias("n_vec"))
    sentences = px.occurrences(spark, sf).groupBy("sent_id", "words").agg(F.min("row_id").alias("row_id"))
    words = sentences.select("row_id", F.explode("words").alias("w")).groupBy("w").agg(F.min("row_id").alias("first"))
    placed = dense_index(durable(words), "first", "k", ties=("w",)).join(F.broadcast(n)).withColumn("vec_id", F.col("k") % F.col("n_vec"))
    return placed.join(vec, "vec_id").select(F.col("w").alias("key"), "v")


DICTIONARY = """, firsts AS (SELECT w, min(row_id) AS first FROM (SELECT row_id, unnest(words) AS w FROM occ) GROUP BY w),
dict AS (SELECT w AS key, v FROM (SELECT w, row_number() OVER (ORDER BY first, w) - 1 AS k FROM firsts) JOIN vec ON vec_id = k % (SELECT count(*) FROM vec)),
feat AS (
  SELECT row_id, 'L' AS side, unnest(left_con) AS feature, generate_subscripts(left_con, 1) - 1 AS pos FROM ctx
  UNION ALL SELECT row_id, 'R', unnest(right_con), generate_subscripts(right_con, 1) - 1 FROM ctx
)"""


def p7_additive_context(spark, sf):
    features = con.context_features(con.with_context(px.occurrences(spark, sf), 2))
    out = con.additive_context(features, word_vectors(spark, sf), 64)
    return out.select("row_id", "side", F.round(F.col("v")[0], 6).alias("v0"), F.round(F.col("v")[63], 6).alias("v63"))


P7 = _context_sql(2) + DICTIONARY + """ SELECT row_id, side, round(coalesce(sum(v[1]), 0), 6) + 0.0 AS v0, round(coalesce(sum(v[64]), 0), 6) + 0.0 AS v63
FROM feat LEFT JOIN dict ON key = feature AND feature <> '<s>' GROUP BY row_id, side"""


def p8_concat_context(spark, sf):
    features = con.context_features(con.with_context(px.occurrences(spark, sf), 2))
    out = con.concatenated_context(features, word_vectors(spark, sf), 64, 3)
    return out.select("row_id", "side", F.size("v").alias("n"), F.round(F.col("v")[0], 6).alias("v0"), F.round(F.col("v")[64], 6).alias("v64"), F.round(F.col("v")[128], 6).alias("v128"))


P8 = _context_sql(2) + DICTIONARY + """, blocks AS (
  SELECT row_id, side, pos, CASE WHEN feature = '<s>' THEN 0.0 ELSE coalesce(v[1], 0.0) END AS x FROM feat LEFT JOIN dict ON key = feature
) SELECT row_id, side, 192 AS n, round(coalesce(max(x) FILTER (pos = 0), 0.0), 6) AS v0, round(coalesce(max(x) FILTER (pos = 1), 0.0), 6) AS v64, round(coalesce(max(x) FILTER (pos = 2), 0.0), 6) AS v128
FROM blocks GROUP BY row_id, side"""


def p9_target_context(spark, sf):
    pairs = px.corpus(spark, sf)
    align = px.alignments(pairs)
    spans = align.select("sent_id", F.col("s").alias("l"), (F.col("s") + 1).alias("r"))
    out = con.target_context(spans, align, pairs.select("sent_id", "tgt"), 2)
    return out.select("sent_id", "l", "r", F.array_join("left_con", " ").alias("left_con"), F.array_join("right_con", " ").alias("right_con"))


P9 = _with(""", m AS (SELECT sent_id, tgt, s, least(s + 1, least(len(src), len(tgt)) - 1) AS hi FROM align JOIN corpus USING (sent_id))
SELECT sent_id, s::INT AS l, (s + 1)::INT AS r, array_to_string(tgt[greatest(s - 2, 0) + 1 : s], ' ') AS left_con,
  array_to_string(list_concat(tgt[hi + 2 : hi + 3], CASE WHEN hi + 2 >= len(tgt) THEN ['</s>'] ELSE []::VARCHAR[] END), ' ') AS right_con FROM m""")


def p10_gold_first(spark, sf):
    kept = top_targets(px.counts(spark, sf), 3)
    lists = kept.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "tgt"))), lambda x: x["tgt"]).alias("cands"))
    rows = px.occurrences(spark, sf).select("row_id", "src", "tgt").join(lists, "src")
    return rows.select("row_id", F.array_join(con.gold_first(F.col("tgt"), F.col("cands"), 3), " / ").alias("cands"))


P10 = _with(""", k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, tgt) AS rn FROM counts),
c AS (SELECT src, list(tgt ORDER BY n DESC, tgt) AS cands FROM k WHERE rn <= 3 GROUP BY src),
o AS (SELECT row_id, tgt, cands, list_filter(cands, lambda x: x <> tgt) AS rest FROM occ JOIN c USING (src))
SELECT row_id, array_to_string(list_concat([tgt], CASE WHEN list_contains(cands, tgt) THEN rest ELSE rest[1 : len(rest) - 1] END)[1:3], ' / ') AS cands FROM o""")


def p12_rule_fields(spark, sf):
    lines = px.phrase_pairs(spark, sf).select("sent_id", F.concat(F.lit("[X_"), "l", F.lit("_"), F.col("r") + 1, F.lit("] ||| "), "src", F.lit(" ||| "), "tgt").alias("line"))
    part = fields(F.col("line"))
    return lines.select("sent_id", bracketed(part[0]).alias("symbol"), part[1].alias("src"), part[2].alias("tgt"))


P12 = _with(" SELECT sent_id, 'X_' || l || '_' || (r + 1) AS symbol, src, tgt FROM pp")


def p13_span_rules(spark, sf):
    from ..operators.scoring import ordered

    rules = px.phrase_pairs(spark, sf).where("l = 1").select("sent_id", "src", "tgt", F.when(F.length("tgt") % 3 > 0, 1.0 / F.length("tgt")).alias("score"))
    return rules.withColumn("place", F.row_number().over(ordered(["sent_id"]))).select("sent_id", "place", "src", "tgt", F.round("score", 6).alias("score"))


P13 = _with(""", r AS (SELECT sent_id, src, tgt, CASE WHEN length(tgt) % 3 > 0 THEN 1.0::DOUBLE / length(tgt) END AS score FROM pp WHERE l = 1)
SELECT sent_id, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC NULLS LAST, tgt)::INT AS place, src, tgt, round(score, 6) AS score FROM r""")


def p14_tree_leaves(spark, sf):
    trees = px.corpus(spark, sf).select("sent_id", F.concat(F.lit("(S "), F.array_join(F.transform("src", lambda w: F.concat(F.lit("(T "), F.regexp_replace(w, r"[()]", ""), F.lit(")"))), " "), F.lit(")")).alias("sexp"))
    return trees.select("sent_id", F.array_join(tree_leaves(F.col("sexp")), " ").alias("leaves"))


P14 = _with(" SELECT sent_id, array_to_string(list_filter(list_transform(src, lambda w: regexp_replace(w, '[()]', '', 'g')), lambda w: w <> ''), ' ') AS leaves FROM corpus")


def t6_lexical_pairs(spark, sf):
    pairs = px.corpus(spark, sf)
    return lexical_pairs(pairs, px.alignments(pairs)).select("sent_id", "ord", "src", "tgt", "l", "r")


T6 = _with(" SELECT sent_id, ord::INT AS ord, src, tgt, l::INT AS l, r::INT AS r FROM pp")


def t5_tree_pairs(spark, sf):
    """Right-branching trees over the aligned words of every sentence."""
    pairs = px.corpus(spark, sf)
    n = F.least(F.size("src"), F.size("tgt"))
    opening = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("("), i.cast("string"))), " ")
    trees = pairs.where(n > 0).select("sent_id", F.concat(opening, F.lit(" "), F.repeat(F.lit(")"), n)).alias("sexp"), "src", "tgt", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("s"), i.alias("t"))).alias("links"))
    return tree_pairs(trees).select("sent_id", "src", "tgt", "rule", "l", "r")


T5 = _with(""", m AS (SELECT sent_id, src, tgt, least(len(src), len(tgt)) AS n FROM corpus),
k AS (SELECT *, unnest(range(greatest(n - 5, 0), n)) AS i FROM m)
SELECT sent_id, array_to_string(src[i + 1 : n], ' ') AS src, array_to_string(tgt[i + 1 : n], ' ') AS tgt,
  src[i + 1] || CASE WHEN i + 1 < n THEN ' [X]' ELSE '' END AS rule, i::INT AS l, (n - 1)::INT AS r FROM k""")


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


QUERIES = {
    "s1_corpus": (s1_corpus, S1),
    "s4_alignments": (s4_alignments, S4),
    "s5_unit_vectors": (s5_unit_vectors, S5),
    "s8_lm_groups": (s8_lm_groups, S8),
    "s13_merged_grammar": (s13_merged_grammar, S13),
    "s14_sgml": (s14_sgml, S14),
    "s15_training_lines": (s15_training_lines, S15),
    "p1_tokens": (p1_tokens, P1),
    "p2_pair_key": (p2_pair_key, P2),
    "p3_context": (p3_context, _context_sql(2) + SHOWN),
    "p4_stop_words": (p4_stop_words, _context_sql(2, _list(STOP)) + SHOWN),
    "p5_frequent_words": (p5_frequent_words, _context_sql(2, frequent=_list(FREQUENT)) + SHOWN),
    "p6_positions": (p6_positions, _context_sql(2, _list(STOP), position=True) + SHOWN),
    "p7_additive_context": (p7_additive_context, P7),
    "p8_concat_context": (p8_concat_context, P8),
    "p9_target_context": (p9_target_context, P9),
    "p10_gold_first": (p10_gold_first, P10),
    "p11_both_sides": (p11_both_sides, _context_sql(1, _list(STOP)) + SHOWN + " WHERE len(left_con) > 0 AND len(right_con) > 0"),
    "p12_rule_fields": (p12_rule_fields, P12),
    "p13_span_rules": (p13_span_rules, P13),
    "p14_tree_leaves": (p14_tree_leaves, P14),
    "t5_tree_pairs": (t5_tree_pairs, T5),
    "t6_lexical_pairs": (t6_lexical_pairs, T6),
}

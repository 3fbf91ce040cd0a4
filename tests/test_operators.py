"""Operators on cases of a few rows whose results are worked out by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.numbering import dense_index, running_total
from tessella.operators import chart, context, counting, evaluation, extraction, features, linalg, models, scoring


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    ("span", "options", "left", "right"),
    [
        ((0, 0), {}, "<s>", "b c"),
        ((1, 1), {}, "<s> a", "c d"),
        ((2, 2), {}, "a b", "d </s>"),
        ((3, 3), {}, "b c", "</s>"),
        ((0, 3), {}, "<s>", "</s>"),
        ((2, 2), {"position": True}, "a_dist2 b_dist1", "d_dist1 </s>"),
        ((2, 2), {"stop": ["b"]}, "a", "d </s>"),
        ((2, 2), {"stop": ["a", "b"]}, "", "d </s>"),
        ((2, 2), {"frequent": ["a"]}, "a <OTHER>", "<OTHER> </s>"),
    ],
)
def test_windows(spark, span, options, left, right):
    given = {k: F.array(*[F.lit(w) for w in v]) if isinstance(v, list) else v for k, v in options.items()}
    words = F.split(F.lit("a b c d"), " ")
    got = spark.range(1).select(*context.source_context(words, F.lit(span[0]), F.lit(span[1]), 2, **given)).first()
    assert (" ".join(got[0]), " ".join(got[1])) == (left, right)
    none = spark.range(1).select(*context.source_context(words, F.lit(1), F.lit(1), 0)).first()
    assert (none[0], none[1]) == ([], [])


def _vocabulary(spark, cutoff, unknown, excluded=None):
    seen = spark.createDataFrame([(k, w, w) for k, w in enumerate("xyxzxy")], "row_id long, src string, tgt string")
    out = spark.createDataFrame([(w, w) for w in excluded], "src string, tgt string") if excluded else None
    vocab, ids = counting.pair_vocabulary(seen, cutoff, out, unknown)
    return {r.type.split(" ")[0]: r.id for r in vocab.collect()}, dict(ids.collect())


def test_vocabulary_cutoffs(spark):
    assert _vocabulary(spark, 0, False)[0] == {"x": 0, "y": 1, "z": 2}
    assert _vocabulary(spark, 1, False) == ({"x": 0, "y": 1}, {0: 0, 1: 1, 2: 0, 4: 0, 5: 1})
    assert _vocabulary(spark, 1, True) == ({"<unk>": 0, "x": 1, "y": 2}, {0: 1, 1: 2, 2: 1, 3: 0, 4: 1, 5: 2})
    assert _vocabulary(spark, 1, False, ["x"]) == ({"y": 0}, {1: 0, 5: 0})
    assert _vocabulary(spark, 1, True, ["x"]) == ({"<unk>": 0, "y": 1}, {0: 0, 1: 1, 2: 0, 3: 0, 4: 0, 5: 1})


def test_top_targets_break_ties_by_name(spark):
    counts = spark.createDataFrame([("s", "c", 2), ("s", "a", 3), ("s", "b", 2)], "src string, tgt string, n long")
    assert rows(counting.top_targets(counts, 2).select("tgt")) == [("a",), ("b",)]
    assert rows(counting.excluded_pairs(counts, 2).select("tgt")) == [("c",)]


def test_frequencies_and_rule_features(spark):
    counts = spark.createDataFrame([("f", "e1", 3), ("f", "e2", 1), ("g", "e1", 1)], "src string, tgt string, n long")
    shares = {(r.src, r.tgt): r for r in features.relative_frequencies(counts).collect()}
    assert shares["f", "e1"].log_e_f == pytest.approx(math.log10(0.75)) == shares["f", "e1"].log_f_e
    got = {(r.src, r.tgt): r for r in features.rule_features(counts).collect()}
    assert got["f", "e2"].e_given_f == pytest.approx(0.602060, abs=1e-6) and got["f", "e1"].sample_count_f == pytest.approx(math.log10(6))
    assert got["f", "e1"].count_ef == pytest.approx(math.log10(4)) and got["f", "e2"].is_singleton_fe == 1 and got["g", "e1"].is_singleton_f == 1


def test_normalisation(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.0), (1, "c", None), (2, "a", 2.0), (2, "b", 2.0)], "g long, tgt string, score double")
    s = F.col("score")
    out = df.select("g", "tgt", scoring.softmax(s, ["g"]).alias("e"), scoring.range_normalised(s, ["g"]).alias("r"), scoring.range_normalised(s, ["g"], True).alias("p"), scoring.range_normalised(s, ["g"], True, True).alias("l"))
    got = {(r.g, r.tgt): r for r in out.collect()}
    assert got[1, "a"].e == pytest.approx(0.731059, abs=1e-6) and got[1, "c"].e is None
    assert [got[1, t].r for t in "abc"] == [0.5, -0.5, None] and [got[1, t].p for t in "abc"] == [1.0, 0.0, None]
    assert [got[1, t].l for t in "abc"] == [2.0, 1.0, None] and got[2, "a"].r == got[2, "b"].r == 0.5
    angles = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (1.0000001,)], "x double").select(scoring.angular(F.col("x"))).collect()
    assert [round(r[0], 6) for r in angles] == [1.0, 0.5, 0.0, 1.0]
    with pytest.raises(ValueError):
        scoring.post_processed(df, ["g"], log=True)


def test_mean_reciprocal_rank(spark):
    data = [(1, "g", 0.9, True), (1, "x", 0.5, False), (1, "y", 0.1, False), (2, "g", 0.2, True), (2, "x", 0.4, False), (3, "g", 1.0, True)]
    data += [(4, "g", None, True), *[(4, t, 0.5, False) for t in "xyz"]]
    df = spark.createDataFrame(data, "row_id long, tgt string, score double, is_gold boolean")
    got = evaluation.report(evaluation.gold_ranks(df)).first()
    assert (got.mrr, got.hard_mrr, got.n_hard, got.mean_cands) == (0.75, 0.5, 1, 4.5)
    assert evaluation.report(evaluation.gold_ranks(df.limit(0))).first().mrr is None


def test_chart_closed_form(spark):
    sentences = spark.createDataFrame([(1, ["a", "b", "c"]), (2, [])], "sent_id long, words array<string>")
    inventory = spark.createDataFrame([("a", "A"), ("a b", "AB")], "src string, tgt string")
    nodes = chart.nodes(sentences)
    spans = chart.span_phrases(sentences, chart.longest_source(inventory))
    assert nodes.count() == 6 and rows(chart.lexical_edges(spans, inventory).select("i", "j")) == [(0, 1), (0, 2)]
    assert rows(chart.unknown_edges(spans, inventory).select("i", "j")) == [(1, 2), (2, 3)]
    edges = chart.binary_edges(nodes)
    assert rows(edges.select("i", "k", "j")) == [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)] and chart.glue_rules(edges).count() == 8
    assert rows(chart.failures(sentences)) == [(2,)]
    lines = [r.line for r in chart.grammar(sentences, inventory).collect()]
    assert len(lines) == len(set(lines)) == 8 + 2 + 1 + 1 and "[S] ||| [X_0_3] ||| [1] ||| 0" in lines


def test_sign_means_and_buckets(spark):
    df = spark.createDataFrame([(k, [x]) for k, x in enumerate([2.0, 4.0, -1.0, 0.0])], "k long, v array<double>")
    means = counting.sign_means(df)
    assert rows(means) == [(0, 3.0, -1.0)] and [r.bucket for r in counting.sign_buckets(df, means, "k").orderBy("k").collect()] == [0, 1, 0, 0]


def test_lexical_pairs_follow_the_alignment(spark):
    corpus = spark.createDataFrame([(1, ["a", "b"], ["x", "y", "z"])], "sent_id long, src array<string>, tgt array<string>")
    align = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 0, 0), (1, 2, 1, 1)], "sent_id long, ord int, s int, t int")
    assert rows(extraction.lexical_pairs(corpus, align).select("src", "tgt", "l", "r")) == [("a", "z x", 0, 0), ("b", "y", 1, 1)]


def test_trees(spark):
    assert extraction.matching_bracket("(a(b)c)d") == 6 and extraction.matching_bracket("((") == -1
    with pytest.raises(ValueError):
        extraction.parse_tree("(1 (2 )")
    got = extraction.tree_phrases("(1 (2 ) 3 )", ["a", "b", "c"], ["x", "y", "z", "w"], [(0, 0), (1, 3), (2, 1)])
    assert [(p["src"], p["tgt"], p["rule"], p["tgt_rule"], p["l"], p["r"]) for p in got] == [("a b c", "x y z w", "a [X] c", "x y [X]", 0, 2), ("b", "w", "b", "w", 1, 1)]
    assert extraction.tree_phrases("((1 2 ) )", ["a", "b"], ["x"], [(0, 0)], max_length=1) == [] and extraction.tree_phrases("", [], [], []) == []


def test_gold_comes_first(spark):
    df = spark.createDataFrame([("g", ["a", "g", "b"]), ("g", ["a", "b", "c"])], "g string, c array<string>")
    assert [r[0] for r in df.select(context.gold_first(F.col("g"), F.col("c"))).collect()] == [["g", "a", "b"], ["g", "a", "b"]]


def test_label_costs(spark):
    df = spark.createDataFrame([(1, "g", 6, True), (1, "a", 3, False), (1, "b", 1, False), (2, "g", 5, True)], "row_id long, tgt string, n long, is_gold boolean")
    assert rows(models.label_costs(df).select("row_id", "tgt", "cost")) == [(1, "a", 3.0), (1, "b", 1.5), (1, "g", 0.0), (2, "g", 0.0)]
    # nothing but the gold candidate was seen: the others' number is the denominator
    unseen = spark.createDataFrame([(1, "g", 5, True), (1, "a", 0, False), (1, "b", 0, False)], "row_id long, tgt string, n long, is_gold boolean")
    assert rows(models.label_costs(unseen).select("tgt", "cost")) == [("a", 1.5), ("b", 1.5), ("g", 0.0)]
    assert {r.cost for r in models.label_costs(df, uniform=True).where("not is_gold").collect()} == {1.0}


def test_hard_rows_and_lm_groups(spark):
    df = spark.createDataFrame([(1, 1.0, True), (1, 2.0, False), (2, 3.0, True), (2, 2.0, False)], "row_id long, cost double, is_gold boolean")
    assert rows(models.hard_rows(df)) == [(2,)]
    lines = spark.createDataFrame([(0, -4.0, "a", 2), (1, -6.0, "a", 2), (2, 0.0, None, 0), (3, -1.0, "b", 1), (4, 1.0, None, 0)], "n long, value double, tgt string, n_words int")
    assert rows(scoring.lm_scores(lines)) == [(0, "a", 3.0), (1, "b", 1.0)]


def test_cca_is_invariant_and_bounded():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(400, 2))
    x, y = np.hstack([z, rng.normal(size=(400, 3))]), np.hstack([z @ rng.normal(size=(2, 2)), rng.normal(size=(400, 2))])
    u, v, s = linalg.cca(x.T @ x, y.T @ y, x.T @ y, 3, 1e-6, 1e-6)
    assert s[:2] == pytest.approx([1, 1], abs=1e-3) and (s <= 1 + 1e-9).all()
    assert u.T @ (x.T @ x) @ u == pytest.approx(np.eye(3), abs=1e-5)
    with pytest.raises(ValueError):
        linalg.dense(None, linalg.DENSE + 1, 1)


def test_featurised_rules(spark):
    counts = spark.createDataFrame([("das haus", "the house", 1), ("es", "it", 3), ("es", "she", 1)], "src string, tgt string, n long")
    given = [("das haus", "the house", ""), ("es", "it", "f=1"), ("es", "it", "PassThrough=1"), ("<unk>", "haus", "PassThrough=1"), ("<unk>", "es", "f=2"), ("es [X_0_1]", "it [X_0_1]", "f=1"), ("es", "they", "")]
    rules = spark.createDataFrame([(k, "[X]", *g) for k, g in enumerate(given)], "sent_id long, lhs string, src string, tgt string, features string")
    got = {r.sent_id: r.line for r in features.featurised_rules(rules, counts).collect()}
    assert got[0] == "[X] ||| das haus ||| the house |||  EgivenF=-0.0 SampleCountF=0.30102999566 CountEF=0.30102999566 IsSingletonF=1 IsSingletonFE=1"
    assert got[1] == "[X] ||| es ||| it ||| f=1 EgivenF=0.12493873661 SampleCountF=0.77815125038 CountEF=0.60205999133 IsSingletonF=0 IsSingletonFE=0"
    assert got[2] == "[X] ||| es ||| it ||| PassThrough=1" and got[3] == "[X] ||| haus ||| haus ||| PassThrough=1"
    assert got[4] == "[X] ||| es ||| es ||| f=2" and got[5] == "[X] ||| es [X_0_1] ||| it [X_0_1] ||| f=1" and got[6] == "[X] ||| es ||| they ||| "
    table = spark.createDataFrame([("es", "it", 0.1, 0.01), ("NULL", "they", 0.001, 0.0), ("NULL", "es", 0.5, 0.0), ("es", "NULL", 0.0, 0.5)], "f string, e string, p_ef double, p_fe double")
    got = {r.sent_id: r.line for r in features.featurised_rules(rules, counts, table).collect()}
    assert got[1].endswith(" MaxLexFgivenE=0.30102999566 MaxLexEgivenF=1.00000000000") and got[6].endswith(" MaxLexFgivenE=0.30102999566 MaxLexEgivenF=3.00000000000")
    assert got[4].endswith("f=2 MaxLexFgivenE=0.30102999566 MaxLexEgivenF=0.30102999566") and "Max" not in got[0] + got[2] + got[3] + got[5]


def test_numbers_of_far_keys(spark):
    keys = [1 << 62, -(1 << 62), (1 << 62) - 1, 5, *range(100, 140), (1 << 61) + 7]
    df = spark.createDataFrame([(k, 2) for k in keys], "k long, n int")
    assert {r.k: r.at for r in dense_index(df, "k", "at").collect()} == {k: i for i, k in enumerate(sorted(keys))}
    assert {r.k: r.before for r in running_total(df, "k", "n", "before").collect()} == {k: 2 * i for i, k in enumerate(sorted(keys))}
    ties = spark.createDataFrame([(1, "b"), (1, "a"), (0, "z")], "k long, t string")
    assert rows(dense_index(ties, "k", "at", ties=("t",)).select("t", "at")) == [("a", 1), ("b", 2), ("z", 0)]
    assert dense_index(df.limit(0), "k", "at").count() == 0


def test_top_and_excluded_pairs_share_the_pairs(spark):
    counts = spark.createDataFrame([("s", c, k % 3) for k, c in enumerate("abcdefg")] + [("t", "a", 1)], "src string, tgt string, n long")
    kept, out = rows(counting.top_targets(counts, 2).select("src", "tgt")), rows(counting.excluded_pairs(counts, 2).select("src", "tgt"))
    assert not set(kept) & set(out) and len(kept) + len(out) == counts.count() and len(kept) == 3


def _cells(spark, m, ids=None):
    return spark.createDataFrame([(i, int(ids[j]) if ids is not None else j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j]], "row_id long, id long, val double")


@pytest.mark.parametrize("whitening", ["full", "diag", "identity"])
def test_randomised_factors_agree_with_dense_ones(spark, whitening):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(60, 2))
    x, y = np.hstack([z, rng.normal(size=(60, 2))]), np.hstack([z @ rng.normal(size=(2, 2)), rng.normal(size=(60, 1))])
    a, b = _cells(spark, x), _cells(spark, y)
    u, v, s = linalg.fit_cca(a, b, 4, 3, 2, 0.1, 0.2, whitening)
    ru, rv, rs = linalg.fit_cca(a, b, 4, 3, 2, 0.1, 0.2, whitening, most=1)
    assert rs == pytest.approx(s, rel=1e-4)
    for t, r, n in ((u, ru, 4), (v, rv, 3)):
        t, r = linalg.as_array(t, n), linalg.as_array(r, n)
        assert np.abs(t @ t.T) == pytest.approx(np.abs(r @ r.T), abs=1e-3)


def test_cca_of_many_columns(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(50, 3))
    x, y = z @ (rng.normal(size=(3, 12)) * (rng.random((3, 12)) < 0.6)), np.hstack([z[:, :1], rng.normal(size=(50, 1))])
    ids = rng.choice(5000, 12, replace=False)
    ids[0] = 4999
    u, v, s = linalg.fit_cca(_cells(spark, x, ids), _cells(spark, y), 5000, 2, 2, 0.5, 0.5)
    _, _, dense = linalg.cca(x.T @ x, y.T @ y, x.T @ y, 2, 0.5, 0.5)
    assert s == pytest.approx(dense, abs=1e-3) and u.count() == np.count_nonzero(np.abs(x).sum(axis=0)) and v.count() == 2


def test_ridge_of_many_columns(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(12, 6)) * (rng.random((12, 6)) < 0.7), rng.normal(size=(12, 2))
    ids = np.array([3, 17, 900, 2500, 4100, 4999])
    want = np.linalg.solve(x.T @ x + 2.0 * np.eye(6), x.T @ y)
    few = linalg.as_array(linalg.ridge(_cells(spark, x), _cells(spark, y), 6, 2, 2.0), 2)
    many = linalg.as_array(linalg.ridge(_cells(spark, x, ids), _cells(spark, y), 5000, 2, 2.0), 2)
    assert few.T == pytest.approx(want, abs=1e-9) and many[:, ids].T == pytest.approx(want, abs=1e-6) and np.count_nonzero(many) == 12


def test_second_order_is_of_printed_values(spark):
    got = spark.range(1).select(scoring.second_order(F.array(F.lit(1.23456), F.lit(0.5)), F.array(F.lit(2.0), F.lit(1000.4)))).first()[0]
    assert got == "op0=2.46 op1=1.23e+03 op2=1 op3=500"


def test_scored_rules(spark):
    data = [(1, 0, 1, "a", "A", 0.0), (1, 0, 1, "a", "B", math.log(3)), (1, 0, 1, "a", "C", None), (1, 1, 2, "b", "D", 5.0)]
    df = spark.createDataFrame(data, "sent_id long, i int, j int, src string, tgt string, score double")
    got = rows(chart.scored_rules(df, normalise="exp", best=True).select("line"))
    assert got == [("[X_0_1] ||| a ||| A ||| cca_on=1 cca_score=0.25",), ("[X_0_1] ||| a ||| B ||| cca_on=1 cca_score=0.75 cca_best=1",), ("[X_0_1] ||| a ||| C ||| cca_off=1",), ("[X_1_2] ||| b ||| D ||| cca_on=1 cca_score=1 cca_best=1",)]


def test_classifier_scores(spark):
    rng = np.random.default_rng(6)
    ctx = [[float(t) for t in v] for v in rng.normal(size=(40, 2))]
    betas = spark.createDataFrame([(0, [1.0, 0.0, 0.5]), (1, [0.0, 1.0, 0.0])], "id long, v array<double>")
    cands = spark.createDataFrame([(i, k, c) for i, c in enumerate(ctx) for k in range(3)], "row_id long, label long, ctx array<double>")
    for r in models.regression_scores(betas, cands).collect():
        cost = {0: r.ctx[0] + 0.5, 1: r.ctx[1]}.get(r.label)
        assert r.score is None if cost is None else r.score == pytest.approx(-cost)
    pairs = spark.createDataFrame([("s", "a", [1.0, 0.0]), ("s", "b", [0.0, 1.0])], "src string, tgt string, v array<double>")
    seen = spark.createDataFrame([("w", [3.0, 4.0])], "key string, v array<double>")
    asked = spark.createDataFrame([(1, "s", "w"), (1, "s", "w"), (2, "s", "?")], "row_id long, src string, feature string")
    got = {(r.row_id, r.tgt): r.score for r in models.skipgram_model(seen, pairs, asked, 2).collect()}
    assert got == {(1, "a"): pytest.approx(0.6), (1, "b"): pytest.approx(0.8), (2, "a"): 0.0, (2, "b"): 0.0}


def test_learners_learn(spark):
    rng = np.random.default_rng(7)
    means = np.array([[4.0, 0.0], [0.0, 4.0], [-4.0, -4.0]])
    label = rng.integers(0, 3, 240)
    x = means[label] + rng.normal(size=(240, 2))
    learn = spark.createDataFrame([(i, [float(t) for t in x[i]], int(label[i])) for i in range(160)], "row_id long, v array<double>, label long")
    ask = spark.createDataFrame([(i, [float(t) for t in x[i]], k, int(label[i]) == k, [float(t) for t in means[k]]) for i in range(160, 240) for k in range(3)], "row_id long, ctx array<double>, label long, is_gold boolean, v array<double>")

    def accuracy(scored):
        best: dict = {}
        for r in scored.collect():
            best[r.row_id] = max(best.get(r.row_id, (-math.inf, False)), (r.score, r.is_gold))
        return sum(gold for _, gold in best.values()) / len(best)

    costs = learn.select("row_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("id"), "label").select("row_id", "id", (F.col("id") != F.col("label")).cast("double").alias("cost"))
    assert accuracy(models.regression_scores(models.cost_regression(learn.select("row_id", "v"), costs, 2, 3), ask)) > 0.9
    assert accuracy(models.label_scores(models.mlp_classifier(learn.select("v", "label"), 4), ask)) > 0.9
    pairs = [([float(t) for t in x[i]], [float(t) for t in means[k]], int(label[i] == k)) for i in range(160) for k in range(3)]
    rows = spark.createDataFrame(pairs, "ctx array<double>, pair array<double>, label int").select(models.matching_features(F.col("ctx"), F.col("pair")).alias("v"), "label")
    assert accuracy(models.matching_scores(models.matching_network(rows, 6), ask)) > 0.9


def test_glue_lines_are_counted_once_a_length(spark):
    sentences = spark.createDataFrame([(7, ["a", "b", "c"]), (8, ["d", "e", "f"]), (9, ["g"]), (10, []), (11, ["h"] * 12)], "sent_id long, words array<string>")
    few = chart.lengths(sentences)
    assert sorted((r.sent_id, len(r.words)) for r in few.collect()) == [(1, 1), (3, 3), (12, 12)]

    def counted(some, nodes):
        lines = chart.glue_rules(chart.binary_edges(nodes(some)))
        return lines.groupBy("sent_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"), F.min("line").alias("first"), F.max("line").alias("last"))

    assert rows(chart.of_length(sentences, counted(few, chart.dealt_nodes))) == rows(counted(sentences, chart.nodes))


def test_glue_queries_build_no_line_twice(spark, monkeypatch):
    from tessella.plans import chart_plans

    sentences = spark.createDataFrame([(k, ["w"] * (3 + k % 2)) for k in range(40)], "sent_id long, words array<string>")
    monkeypatch.setattr(chart_plans, "_sentences", lambda spark, sf: sentences)
    built, edges = [], chart.binary_edges
    monkeypatch.setattr(chart, "binary_edges", lambda spans: built.append(edges(spans)) or built[-1])
    glue, triples = chart_plans.g8_glue_rules(spark, ""), chart_plans.g4_binary_edges(spark, "")
    assert [b.count() for b in built] == [4 + 10] * 2  # of three words and of four
    assert sorted(r.n for r in triples.collect()) == [4] * 20 + [10] * 20 and sorted(r.n for r in glue.collect()) == [8] * 20 + [20] * 20


def test_a_norm_is_computed_once_a_row(spark):
    from tessella.functions.vectors import unit

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "a array<double>").select(unit(F.col("a")).alias("u"))
    assert [r.u for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]
    assert df._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1


def test_entries_are_summed_by_blocks(spark):
    from tessella.operators.lookup import summed_entries

    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(30)]
    data = [(int(k) << 16 | int(o), "LR"[k % 2], words[int(w)], float(x)) for k, o, w, x in zip(rng.integers(0, 40, 400), rng.integers(0, 3, 400), rng.integers(0, 30, 400), rng.normal(size=400), strict=True)]
    vectors = {w: [float(t) for t in rng.normal(size=3)] for w in words[:20]}
    entries = spark.createDataFrame(data, "row_id long, side string, id string, val double")
    table = spark.createDataFrame([*vectors.items(), ("w0", [1.0, 1.0, 1.0]), ("w25", None)], "id string, v array<double>")
    vectors["w0"] = [x + 1 for x in vectors["w0"]]
    want = {(k, s): np.zeros(3) for k, s, _, _ in data}
    for k, s, w, x in data:
        want[k, s] += x * np.array(vectors.get(w, [0.0] * 3))
    for block in (7, 1 << 17):
        got = {(r.row_id, r.side): r.v for r in summed_entries(entries, "row_id", table, 3, ("side",), zeros=True, block=block).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    known = {k for k, _, w, _ in data if w in vectors}
    assert {r.row_id for r in summed_entries(entries.drop("side"), "row_id", table, 3, block=50).collect()} == known
    assert summed_entries(entries.limit(0), "row_id", table, 3).count() == 0 and summed_entries(entries.drop("side"), "row_id", table.limit(0), 3).count() == 0


def test_context_sums_ship_a_vector_once_a_block(spark):
    features = spark.createDataFrame([(k, "L", p, "w") for k in range(500) for p in range(2)], "row_id long, side string, pos int, feature string")
    vectors = spark.createDataFrame([("w", [1.0, 2.0])], "key string, v array<double>")
    out = context.additive_context(features, vectors, 2)
    assert {tuple(r.v) for r in out.collect()} == {(2.0, 4.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate" not in plan  # vectors aren't taken apart


def test_passes_add_columns_instead_of_exploded_vectors(spark):
    cells = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (2, 1, -1.0)], "row_id long, id long, val double")
    basis = spark.createDataFrame([(0, [1.0, 10.0]), (1, [0.5, 0.0])], "id long, v array<double>")
    product = cells.select(F.col("row_id").alias("i"), F.col("id").alias("j"), "val")
    for out in (linalg.projected(cells, basis, 2), linalg._times(product, basis, 2)):
        assert {tuple(r) for r in out.select(F.col(out.columns[0]), F.col("v")[0], F.col("v")[1]).collect()} == {(1, 3.5, 20.0), (2, -0.5, 0.0)}
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()

"""Every query with SQL against DuckDB over the smallest tables; the others by properties."""

from __future__ import annotations

from pathlib import Path

import pytest
from oracle import difference
from pyspark.sql import functions as F

from tessella.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    ours, theirs, more, less = difference(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)
    assert ours == theirs
    assert not more and not less, (list(more.items())[:3], list(less.items())[:3])


def test_every_query_is_named_once():
    names = [n for m in registry.MODULES for n in m.QUERIES]
    assert len(names) == len(set(names)) and registry.FLAGSHIP in names
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_held_out_is_exact_and_stable(spark):
    query = registry.queries()["a14_held_out"]
    a, b = ({r.row_id for r in query(spark, SF).collect()} for _ in range(2))
    total = registry.queries()["p3_context"](spark, SF).count()
    assert a == b and len(a) == int(0.1 * total)


def test_cca_whitens_and_correlates(spark):
    rows = registry.queries()["l6_cca"](spark, SF).collect()
    assert all(0 <= r.correlation <= 1 and r.off < 1e-6 for r in rows)
    two = registry.queries()["m2_two_step_cca"](spark, SF).collect()
    assert all(-1e-9 <= r.correlation <= 1 for r in two)


def test_randomised_svd_agrees_with_dense(spark):
    near = [r.sigma for r in sorted(registry.queries()["l8_randomised_svd"](spark, SF).collect())]
    dense = [r.sigma for r in sorted(registry.queries()["l5_identity_svd"](spark, SF).collect())]
    assert near == pytest.approx(dense, rel=2e-3)


def test_held_out_reports_are_shares(spark):
    """The stand-ins' labels have nothing to do with their vectors; that the learners learn is tested on planted data."""
    for name in ("m7_matching_network", "m9_cost_regression", "m12_mlp"):
        rows = registry.queries()[name](spark, SF).collect()
        assert rows and all(0 <= r.accuracy <= 1 and r.n > 0 for r in rows)


def test_candidates_without_parameters_score_nothing(spark):
    for name in ("c5_matching_scores", "c6_regression_scores"):
        rows = registry.queries()[name](spark, SF).collect()
        assert rows and all((r.score is None) == (r.tgt == "9") for r in rows)
    seen: dict = {}
    for r in registry.queries()["c7_mlp_scores"](spark, SF).collect():
        seen[r.row_id] = seen.get(r.row_id, 0.0) + r.score
    assert seen and all(abs(x - 1) < 1e-4 for x in seen.values())


def test_contexts_correlate(spark):
    rows = registry.queries()["m1_context_cca"](spark, SF).collect()
    found = [r.correlation for r in sorted(rows)]
    assert len(found) == 5 and found == sorted(found, reverse=True) and 0.3 < found[0] <= 1 + 1e-6


def test_held_out_report_asks_the_network_about_held_out_rows_only(spark, monkeypatch):
    from tessella.plans import numeric_plans

    scored = spark.createDataFrame([(True, 0.9), (True, 0.1), (False, 0.2), (False, None)], "is_gold boolean, score double")
    monkeypatch.setattr(numeric_plans, "_matched", lambda spark, sf: scored)
    out = numeric_plans.m7_matching_network(spark, "")
    assert sorted(map(tuple, out.collect())) == [(0, 1, 1.0), (1, 2, 0.5)]
    assert "isnotnull(score" not in out._jdf.queryExecution().optimizedPlan().toString()  # a filter would go below the joins
    monkeypatch.setattr(numeric_plans, "_matched", lambda spark, sf: scored.where("score is null"))
    assert numeric_plans.m7_matching_network(spark, "").count() == 0


def test_matching_network_gets_its_size_and_all_pairs(spark, monkeypatch):
    from tessella.plans import numeric_plans

    seen = {}
    monkeypatch.setattr(numeric_plans.mo, "matching_network", lambda rows, rank, **known: seen.update(rows=rows, **known))
    monkeypatch.setattr(numeric_plans.mo, "matching_scores", lambda model, score: score)
    numeric_plans._matched(spark, SF)
    learn, _ = numeric_plans._parted(spark, SF)
    known = learn.where("v is not null").select("row_id", "tgt", "is_gold", numeric_plans.mo.matching_features(F.col("ctx"), F.col("v")).alias("v"))
    pairs = numeric_plans.mo.matching_set(known).join(known.drop("is_gold"), ["row_id", "tgt"])
    shown = lambda rows: sorted((r.label, *(round(x, 9) for x in r.v[::24])) for r in rows.collect())
    want = shown(pairs.select("v", ((F.col("label") + 1) / 2).cast("int").alias("label")))
    assert seen["size"] == 192 and len(want) > 0 and shown(seen["rows"]) == want


def test_order_takes_equal_scores_up_to_rounding_as_ties(spark, monkeypatch):
    from tessella.plans import score_plans

    data = [(1, "a", "lm_f_e", -1.0000000000000002), (1, "b", "lm_f_e", -1.0), (1, "c", "lm_f_e", -0.5), (1, "c", "lm", 0.0)]
    scores = spark.createDataFrame(data, "row_id long, tgt string, variant string, score double")
    monkeypatch.setattr(score_plans, "_channel", lambda spark, sf: scores)
    assert sorted((r.place, r.tgt) for r in score_plans.c19_order(spark, "").collect()) == [(1, "c"), (2, "a"), (3, "b")]


def test_projection_ships_a_vector_once_a_block(spark):
    out = registry.queries()["l9_projection"](spark, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "posexplode" not in plan  # vectors aren't taken apart

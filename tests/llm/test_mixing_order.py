"""Targets when sources tie, and the order of what the mix takes more than once."""

from __future__ import annotations

import pytest

from tessella.llm import mixing

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize(
    ("sizes", "targets"),
    [
        ([500, 200], [500, 200]),
        ([500, 200, 100], [500, 200, 100]),
        ([100, 100, 100, 100], [5 * 400 / 13, 2 * 400 / 13, 400 / 13, 5 * 400 / 13]),
        ([10, 10, 10, 10, 970], [30, 30, 30, 30, 890]),
    ],
)
def test_targets_of_ties(spark, sizes, targets):
    df = spark.createDataFrame([(chr(97 + k), n) for k, n in enumerate(sizes)], "source string, size long")
    got = [r.target for r in sorted(mixing.source_targets(df).collect())]
    assert sum(got) == pytest.approx(sum(sizes))
    assert got == pytest.approx(targets)


def test_order_follows_every_copy(spark):
    rows = [(i, "w " * 10, "a") for i in range(40)] + [(100 + i, "w " * 10, "b") for i in range(400)] + [(None, f"w{i} " * 10, "a") for i in range(10)]
    df = spark.createDataFrame(rows, DOCS)
    order = [r.source for r in mixing.mixed_rows(df, tilt=0.0).collect()]
    at = [k / len(order) for k, s in enumerate(order) if s == "a"]
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect() if r.doc_id is not None}
    assert len(at) == 150 and all(copies[i] == 3 for i in range(40))
    # without a tilt a source is as frequent at any time
    assert all(abs(x - (k + 0.5) / len(at)) < 0.05 for k, x in enumerate(at))
    passes = [r.doc_id for r in mixing.mixed_rows(df, tilt=0.0).collect() if r.source == "a" and r.doc_id is not None]
    assert passes[:40] == passes[40:80] == passes[80:]
    assert mixing.mixed_rows(df.limit(0)).count() == 0

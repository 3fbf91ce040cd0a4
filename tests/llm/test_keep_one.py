"""One row of each near-duplicate component, whatever its identifiers are."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tessella.llm import common, simhash


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_rows_without_identifier_stay_apart(spark):
    texts = sorted(prose(k) for k in range(4))
    assert kept(spark, [(None, t) for t in texts]) == [(None, t) for t in texts]


def test_identifier_of_two_texts(spark):
    a, b = prose(1), prose(2)
    assert kept(spark, [(1, a), (5, a.upper()), (5, b)]) == [(1, a), (5, b)]
    assert kept(spark, [(None, a), (7, a.upper())]) == [(7, a.upper())]
    assert kept(spark, [(3, a), (3, a)]) == [(3, a)]


def test_choice_does_not_follow_row_order(spark):
    a = prose(3)
    rows = [(None, a), (None, a.upper()), (None, a.title())]
    assert kept(spark, rows) == kept(spark, rows[::-1]) and len(kept(spark, rows)) == 1
    assert simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").where(F.lit(False))).count() == 0


def brute(texts, width=5, similarity=0.8):
    """Positions of the first text of each component."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    first, left = [], set(range(len(texts)))
    while left:
        todo = [min(left)]
        first.append(todo[0])
        left -= set(todo)
        while todo:
            x = sets[todo.pop()]
            near = {b for b in left if x == sets[b] or len(x & sets[b]) >= similarity * len(x | sets[b]) > 0}
            todo += near
            left -= near
    return first


def edited(rng, text, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_near_copies_of_edited_words_go(spark):
    rng = random.Random(5)
    base = prose(9, 200)
    words = base.split()
    words[50] = words[120] = "changed"
    texts = [base, " ".join(words), edited(rng, base, 0.5), "", " ", "one two", "ONE two", "one three", prose(10, 5)]
    assert [i for i, _ in kept(spark, list(enumerate(texts)))] == brute(texts) == [0, 2, 3, 5, 7, 8]


def test_components_of_large_and_small_groups(spark):
    rng = random.Random(6)
    hot, line = prose(11, 120), prose(12, 20)
    texts = [edited(rng, hot, rng.choice([0.005, 0.01, 0.02, 0.03, 0.06])) for _ in range(150)]
    texts += [f"{prose(100 + k, rng.randint(5, 30))} {line}" for k in range(80)]
    for k in range(20):
        own = prose(300 + k, rng.randint(3, 150))
        texts += [own, edited(rng, own, 0.01), edited(rng, own, 0.03)]
    rng.shuffle(texts)
    assert [i for i, _ in kept(spark, list(enumerate(texts)))] == brute(texts)


def shuffled(spark):
    """Names of the shuffle files that are on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {x for x in names if x.startswith("shuffle_")}


def test_shuffles_go_with_the_step_that_needs_them(spark):
    rng = random.Random(7)
    hot = prose(13, 120)
    rows = [(k, edited(rng, hot, 0.01)) for k in range(60)] + [(100 + k, prose(600 + k)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = shuffled(spark)
    stays = simhash.keep_one(df)
    left = shuffled(spark) - before
    for _ in range(20):  # files go a moment after their step
        if not left:
            break
        time.sleep(0.5)
        left = shuffled(spark) - before
    assert not left
    assert sorted(r.doc_id for r in stays.collect()) == [rows[i][0] for i in brute([t for _, t in rows])]


@pytest.mark.parametrize("value", [None, "false", "true"])
def test_setting_of_freed_shuffles_is_put_back(spark, value):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        was = spark.conf.get(key, None)
        with pytest.raises(ZeroDivisionError), common.shuffles_freed(spark):
            assert spark.conf.get(key) == "true"
            1 / 0
        assert spark.conf.get(key, None) == was
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)

"""Repeated passages: runs and intervals against plain loops, long texts, and a text that stands in every partition."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import suffix_dedup

COLUMNS = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"


def brute(rows, width=50):
    seen: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            seen[w] = min(seen.get(w, i), i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] < i:
                gone[p : p + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    return out


def test_intervals_join_where_they_touch():
    rng = np.random.default_rng(5)
    part, uid, first = rng.integers(0, 2, 300), rng.integers(0, 3, 300), rng.integers(0, 500, 300)
    last = first + rng.integers(1, 40, 300)
    want = set()
    for p in (0, 1):
        for u in (0, 1, 2):
            covered = np.zeros(600, int)
            for a, b in zip(first[(part == p) & (uid == u)], last[(part == p) & (uid == u)], strict=True):
                covered[a:b] = 1
            steps = np.diff(np.concatenate([[0], covered, [0]]))
            want |= {(p, u, int(a), int(b)) for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1), strict=True)}
    assert {tuple(r.values()) for r in suffix_dedup._intervals(part, uid, first, last).to_pylist()} == want
    assert suffix_dedup._intervals(*[np.zeros(0, np.int64)] * 4).num_rows == 0


def test_runs_merge_to_the_smallest_documents():
    rng = np.random.default_rng(6)
    runs, want = [], {}
    for _ in range(7):
        words = sorted({bytes(rng.integers(0, 2, 4, np.uint8)) + b"\x01" for _ in range(9)})
        docs = rng.integers(0, 100, len(words))
        runs.append((np.array(words, "S5"), docs))
        for w, d in zip(words, docs.tolist(), strict=True):
            want[w] = min(want.get(w, d), d)
    windows, least = suffix_dedup.merged_runs(runs)
    assert [bytes(w) for w in windows] == sorted(want) and least.tolist() == [want[bytes(w)] for w in windows]


def test_long_texts_and_a_text_in_every_partition(spark):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop é") for _ in range(n))
    passage, popular = noise(300), noise(400)
    # passages across the borders of the pieces and blocks that long texts are taken in
    long = noise(89_900) + passage + noise(60_000) + popular[50:350] + noise(41_000)
    rows = [(7, long), (3, noise(131_000) + passage + noise(2000) + long[149_000:151_000]), (9, long[100:190_000])]
    rows += [(1000 + k, popular) for k in range(300)] + [(500, popular + "!"), (2000, popular), (2001, None), (2002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16, F.col("doc_id"))
    for hot in (1, 2000):
        out = suffix_dedup.remove_repeats(df, hot=hot, chunk=4000)
        assert Counter(tuple(r[c] for c in COLUMNS) for r in out.collect()) == brute(rows)


def test_nothing_is_left_behind(spark):
    df = spark.createDataFrame([(1, "a" * 60), (2, "b" + "a" * 60)], "doc_id long, text string")
    suffix_dedup.remove_repeats(df).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessella_")]

"""Near-dedup's fingerprint index: its candidates, what it links by itself, and that the exact step needs none of it."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from test_keep_one import brute, edited, kept, prose
from tessella.llm import resemblance, simhash


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    out = []
    for k in range(25):
        own = prose(500 + k, 250)
        words = own.split()
        words[rng.randrange(100, 150)] = "changed"
        out += [own, " ".join(words), edited(rng, own, 0.02), edited(rng, own, 0.6)]
    return out


def test_index_links_near_copies_by_itself(spark, texts, monkeypatch):
    monkeypatch.setattr(resemblance, "pairs_of", lambda similarity, across: lambda batches: iter(()))
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    stays = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").select("doc_id").collect()}
    # one changed word of 250 changes few bits, in few bytes mostly; no text goes that brute force keeps
    found = sum(k not in stays for k in range(1, len(texts), 4))
    assert found >= 18 and set(brute(texts)) <= stays


def test_exact_step_finds_all_without_the_index(spark, texts, monkeypatch):
    monkeypatch.setattr(simhash, "candidates", lambda fps: spark.createDataFrame([], "a long, b long, bits int"))
    assert [i for i, _ in kept(spark, list(enumerate(texts)))] == brute(texts)


def test_candidates_against_all_pairs(spark):
    rng = random.Random(13)
    fps = [rng.getrandbits(64) for _ in range(200)]
    for base in fps[:100]:
        x = base
        for bit in rng.sample(range(64), rng.randrange(14)):
            x ^= 1 << bit
        fps.append(x)
    fps += [fps[0], 0]
    rows = list(enumerate(int(np.uint64(x).view(np.int64)) for x in fps))
    got = {(r.a, r.b): r.bits for r in simhash.candidates(spark.createDataFrame(rows, "key long, fp long").repartition(3)).collect()}
    want = {}
    for i, x in enumerate(fps):
        for j in range(i):
            shared = sum((x ^ fps[j]) >> (8 * p) & 255 == 0 for p in range(8))
            if shared >= simhash.NEAR_SHARED and (x ^ fps[j]).bit_count() <= simhash.NEAR_BITS:
                want[j, i] = (x ^ fps[j]).bit_count()
    assert got == want and len(want) > 50
    # a posting above LARGE members: each with the next, over batches of any size
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    try:
        same = {(r.a, r.b) for r in simhash.candidates(spark.createDataFrame([(k, 5) for k in range(100)], "key long, fp long")).collect()}
    finally:
        spark.conf.set(key, before)
    assert same == {(k, k + 1) for k in range(99)}

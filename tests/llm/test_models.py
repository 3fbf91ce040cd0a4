"""Learners against plain loops, and every query of the training-data operators over the smallest tables."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pytest

from tessella.llm import langid, quality, queries, simhash

SF = "/root/testdata/sf0.001"


def test_ftrl_is_the_plain_loop():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcde"), 12)) for _ in range(8)] + ["".join(rng.choice(list("vwxyz"), 12)) for _ in range(8)]
    y = np.array([0] * 8 + [1] * 8)
    vectors = [langid.text_vector(t) for t in texts]
    df = np.zeros(langid.SLOTS + 1, np.int64)
    for at, _ in vectors:
        df[at] += 1
    df[-1] = len(texts)
    alpha, beta, l1, l2, back = 0.3, 1.0, 0.02, 0.02, 5
    model = langid.fit(vectors, y, ["a", "b"], df, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, back=back)
    idf = [np.log((1 + len(texts)) / (1 + d)) + 1 for d in df[:-1]]
    z, n = {}, {}

    def weight(slot, k):
        v = z.get((slot, k), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((beta + np.sqrt(n.get((slot, k), 0.0))) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(2):
        for i in order.permutation([i for i in range(len(y)) if i % back]):
            x = {int(s): v * idf[s] * langid.SCALE for s, v in zip(*vectors[i], strict=True)} | {langid.SLOTS: 1.0}
            w = {(s, k): weight(s, k) for s in x for k in (0, 1)}
            out = np.array([sum(v * w[s, k] for s, v in x.items()) for k in (0, 1)])
            p = np.exp(out - out.max()) / np.exp(out - out.max()).sum()
            for s, v in x.items():
                for k in (0, 1):
                    g = v * (p[k] - (y[i] == k))
                    old = n.get((s, k), 0.0)
                    z[s, k] = z.get((s, k), 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w[s, k]
                    n[s, k] = old + g * g
    for s, k in z:
        got = model.bias[k] if s == langid.SLOTS else model.weights[s, k]
        assert got == pytest.approx(weight(s, k), abs=1e-9)
    assert np.count_nonzero(model.weights) <= len(z)


def test_counted_slots_are_the_most_frequent():
    text = "the cat sat on the mat and the rat sat on the hat " * 3
    at, share = langid.text_vector(text)
    few, some = langid.text_vector(text, 10)
    assert len(few) == 10 and set(few) <= set(at) and some.min() >= np.sort(share)[-10] - 1e-12


def test_flat_trees_score_like_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    trees = quality.train(x, y, [1, 0, 0, -1], trees=12)

    def walk(node, row):
        if trees.feature[node] < 0:
            return trees.value[node]
        return walk(trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node], row)

    for row, got in zip(x[:100], trees.margin(x[:100]), strict=True):
        assert got == pytest.approx(trees.base + sum(walk(r, row) for r in trees.roots))


def brute_fingerprint(text):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_pairs_meet_in_a_posting():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
        met = [m for m in simhash.masks(simhash.FIXED) if (a ^ b) & m & (2**64 - 1) == 0]
        assert met
        given = tuple(p for p in range(8) if met[0] >> (8 * p) & 1)
        assert any((a ^ b) & m & (2**64 - 1) == 0 for m in simhash.masks(simhash.REFINED, given))
    assert len(simhash.masks(simhash.FIXED)) == 15


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, name):
    if name == "op10_packing":
        pytest.importorskip("public_tokenizers")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.queries()[name](spark, SF).collect()
    columns = {
        "op1_toxicity": "doc_id held_out score predicted", "op2_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op3_mixing": "doc_id size source_size target taken",
        "op4_language_id": "doc_id held_out lang_pred score", "op5_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op6_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op7_simhash": "doc_id fingerprint component_id", "op8_url_filter": "page_id host path rule verdict", "op9_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op10_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    }[name].split()
    assert set(columns) <= set(out[0].asDict())
    if name not in ("op8_url_filter", "op10_packing"):
        assert sorted(r.doc_id for r in out) == sorted(docs)
    if name == "op7_simhash":
        assert all(r.fingerprint == f"{brute_fingerprint(docs[r.doc_id]):016x}" for r in out)
    if name == "op5_sharding":
        assert all(r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) and 0 <= r.shard < 24 for r in out)
    if name == "op10_packing":
        assert {r.doc_id for r in out} == set(docs) and sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())
        filled: dict = {}
        for r in out:
            filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
        assert max(filled.values()) <= 1024 and sum(filled.values()) > 0.9 * 1024 * len(filled)

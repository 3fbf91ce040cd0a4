"""Training-data operators against brute force on small tables, with the awkward rows each must take."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, langid, mixing, packing, quality, sharding, simhash, suffix_dedup, toxicity, urls
from tessella.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, digest string, row string, part int"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns whose names clash with internal ones."""
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS)


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(30)
    rows = []
    for i in range(60):
        t = text(rng.choice([0, 1, 2, 3, 10, 80]))
        if i % 4 == 0:
            t = f"{t} {shared} {text(5)}"
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None])))
    rows += [(60, rows[4][1], "en", "a"), (61, rows[8][1] + "  ", "en", "b"), (62, None, None, None), (63, "", "en", "a"), (64, " \t\n", "de", "b")]
    rows += [(65, "ééé ßßß \u00a0 日本語 " * 20, "fr", None), (66, text(4000), "en", "a"), (60, rows[4][1], "en", "a"), (None, "no id", "en", "a"), (None, "no id", "en", "a")]
    return rows


EMPTY: list = []


def table(df):
    return [tuple(r) for r in df.collect()]


def test_exact_dedup(spark, sample):
    out = table(exact_dedup.exact_dedup(docs(spark, sample)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict = {}
    for i, t, *_ in sample:
        groups.setdefault(norm(t), []).append(i)
    want = Counter()
    for t, ids in groups.items():
        low = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda x: (x is None, x or 0))):
            want[(i, low, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(out) == want
    kept = exact_dedup.keep_first(docs(spark, sample))
    assert kept.columns == docs(spark, sample).columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(docs(spark, EMPTY)).count() == 0 and exact_dedup.keep_first(docs(spark, EMPTY)).count() == 0


def test_exact_dedup_of_many_arrow_batches(spark):
    """Partitions that Python gets in several batches, with groups that go on from one batch to the next."""
    rows = [(i, f"text {i % 7 if i % 2 else i}", "en", "a") for i in range(60)]
    first: dict = {}
    for i, t, *_ in rows:
        first.setdefault(t, i)
    size = Counter(t for _, t, *_ in rows)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        out = table(exact_dedup.exact_dedup(docs(spark, rows)).select("doc_id", "keep_id", "group_size", "kept"))
        kept = exact_dedup.keep_first(docs(spark, rows)).select("doc_id").collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(out) == [(i, first[t], size[t], first[t] == i) for i, t, *_ in rows]
    assert sorted(r.doc_id for r in kept) == sorted(first.values())


def test_sharding(spark, sample):
    out = sharding.shard_documents(docs(spark, sample), shards=7)
    rows = table(out.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"))
    assert Counter((i, s, c) for i, s, c, *_ in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in sample)
    by: dict = {}
    for *_, shard, slot, grown in rows:
        by.setdefault(shard, []).append(slot)
        assert grown is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(k, [])) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert Counter(rows) == Counter(table(sharding.shard_documents(docs(spark, sample).repartition(5), shards=7).select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")))
    assert sharding.shard_documents(docs(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000])
def test_feistel_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5)).collect()]
    assert sorted(got) == list(range(n))


def test_urls(spark):
    given = ["http://a.com/en/1", "HTTP://X.Example.COM/en/77?q", "https://example.com", "x://b.net/de/9#f", "x://EXAMPLE.net/de/8/", "no scheme.com/en/", None, "", "://org/es/", "q://notcom/en/", "a://u.com:80/en/", "z://c.org/es/x\n/y"] * 2
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(given)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, urls.rule_table(spark)).collect()}

    def brute(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")

    assert got == {k: brute(u) for k, u in enumerate(given)}
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in urls.judge_urls(pages, none).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), urls.rule_table(spark)).count() == 0


def test_mixing(spark, sample):
    rows = mixing.mix(docs(spark, sample)).collect()
    size = Counter()
    for i, t, _, s in sample:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in sample)
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(size.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        for s in over or free:
            target[s] = 3.0 * size[s] if over else level * weight[s]
        if not over:
            break
        rest -= sum(target[s] for s in over)
        free -= over
    taken = Counter()
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        assert len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in order)
    told = lambda found: Counter((r.doc_id, r.source, r.size, r.target, r.taken, *r.positions) for r in found)
    assert told(rows) == told(mixing.mix(docs(spark, sample).repartition(3)).collect())
    first = [r.positions[0] for r in rows if r.positions]
    assert first == sorted(first)
    assert mixing.mix(docs(spark, EMPTY)).count() == 0


def test_mixing_caps_and_positions(spark):
    rows = [(i, "w " * 10, None, "a") for i in range(3)] + [(10 + i, "w " * 10, None, "b") for i in range(300)]
    out = mixing.mix(docs(spark, rows)).collect()
    assert {r.target for r in out if r.source == "a"} == {90.0} and all(r.taken == 30 for r in out if r.source == "a")
    assert abs(sum(r.taken for r in out) - 3030) <= 10
    early = sorted(r.positions[0] for r in out if r.source == "b" and r.positions)
    assert early[0] < 0.05 and early[-1] > 0.95


def test_demand_inverts(spark):
    knots = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, 1.0), (0.4, 0.0), (0.7, 2.0), (1.0, 2.0))])
    shares = [k / 20 for k in range(21)]
    got = spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.position(knots, mixing.demand(knots), F.col("s"))).collect()
    grid = np.linspace(0, 1, 200_001)
    w = np.interp(grid, [0, 0.4, 0.7, 1], [1, 0, 2, 2])
    filled = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2) * (grid[1] - grid[0])])
    for s, (t,) in zip(shares, got, strict=True):
        assert abs(np.interp(t, grid, filled) - s * filled[-1]) < 1e-4


def brute_fingerprint(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(sample):
    for _, t, *_ in [*sample, (0, "A Bé C a bé c", None, None)]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_near_duplicates(spark, sample):
    out = table(simhash.near_duplicates(docs(spark, sample)).select("doc_id", "component_id"))
    fp = {t: brute_fingerprint(t) for _, t, *_ in sample}
    values = sorted(set(fp.values()))
    root = {v: v for v in values}
    for _ in values:
        for a in values:
            root[a] = min(root[b] for b in values if bin(a ^ b).count("1") <= 2)
    least: dict = {}
    for i, t, *_ in sample:
        if i is not None:
            least[root[fp[t]]] = min(least.get(root[fp[t]], i), i)
    assert Counter(out) == Counter((i, least.get(root[fp[t]])) for i, t, *_ in sample)
    assert simhash.near_duplicates(docs(spark, EMPTY)).count() == 0
    assert simhash.keep_one(docs(spark, sample)).columns == docs(spark, sample).columns


def test_links_in_large_postings(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    flips = [b ^ np.uint64(x) for b in base for x in rng.integers(0, 1 << 14, 150, dtype=np.uint64)]
    fps = np.unique(np.array([*flips, *rng.integers(0, 2**63, 200, dtype=np.uint64)], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = simhash.linked(df).collect()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            break
        label = new
    where = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    got = np.arange(len(fps))
    for a, b in edges:
        assert label[where[a]] == label[where[b]]
    for _ in range(len(fps)):
        before = got.copy()
        for a, b in edges:
            low = min(got[where[a]], got[where[b]])
            got[where[a]] = got[where[b]] = low
        if (before == got).all():
            break
    assert (got == label).all()


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, width=50):
    seen: dict = {}
    for i, t, *_ in rows:
        b, key = (t or "").encode(), (i is None, i or 0)
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            seen[w] = min(seen.get(w, key), key)
    out = Counter()
    for i, t, *_ in rows:
        b, key = (t or "").encode(), (i is None, i or 0)
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] < key:
                gone[p : p + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [2, 2000])
def test_suffix_dedup(spark, sample, hot):
    rng = random.Random(9)
    long = "".join(rng.choice("ab ") for _ in range(400))
    rows = [*sample, (70, long + "x" * 200, None, None), (71, "y" * 120 + long[17:], None, None), (72, "x" * 90 + long[:60] + "x" * 49, None, None), (69, long[3:353], None, None)]
    out = suffix_dedup.remove_repeats(docs(spark, rows), hot=hot, chunk=2000)
    assert Counter(table(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))) == brute_repeats(rows)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.remove_repeats(docs(spark, EMPTY)).count() == 0


def test_suffix_array_orders_by_depth():
    rng = np.random.default_rng(0)
    text = np.concatenate([rng.integers(1, 4, 300), np.full(120, 2), rng.integers(1, 3, 100)]).astype(np.int16)
    order = suffix_dedup.suffix_array(text, 50)
    keys = [tuple(text[i : i + 50]) for i in order]
    assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)
    prefix = suffix_dedup.common_prefixes(text, order, 50)
    for a, b in zip(order, order[1:], strict=False):
        n = next((k for k in range(50) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]), 50)
        assert prefix[b] == n


def test_packing(spark, sample):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = [*sample, (80, "a  b \n c\u2003d e<|endoftext|>f 's 12 don't  ", None, None), (81, " lead", None, None)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    exact = Tokenizer.from_file(path)
    got = packing.pack_documents(docs(spark, rows).where("doc_id is not null").dropDuplicates(["doc_id"]), path).collect()
    by_doc: dict = {}
    by_seq: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in {i: t for i, t, *_ in rows if i is not None}.items():
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack_documents(docs(spark, EMPTY), path).count() == 0


def test_differencing_is_even_and_whole():
    rng = random.Random(1)
    sizes = [rng.randint(1, 256) for _ in range(200)]
    sets = packing.differencing(sizes, 16)
    assert sorted(i for s in sets for i in s) == list(range(200))
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert max(sums) - min(sums) <= 60
    assert all(sum(sizes[i] for i in s) <= 300 for s in packing.pack(sizes, 300))
    # three pieces of 600 don't fit two windows of 1,000, so the count rises to three
    assert sorted(map(sorted, packing.pack([600, 600, 600], 1000))) == [[0], [1], [2]]


def test_language_id(spark):
    rng = random.Random(2)
    syllables = {"aa": ["ka", "ro", "mi"], "bb": ["zu", "the", "wo"], "cc": ["éx", "ñi", "la"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))
        rows.append((i, text, lang, None))
    extra = [(1000, None, "aa", None), (1001, "", None, None), (1002, "123 $$$", "bb", None), (1003, "_ 9", None, None), (None, "karo", None, None)]
    out = {r.doc_id: r for r in langid.identify(docs(spark, rows + extra)).collect()}
    for i, _, lang, _ in rows:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= out[i].score <= 1
    held = [(out[i].lang_pred, lang) for i, _, lang, _ in rows if out[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(out[i].lang_pred == "und" for i in (1000, 1001, 1002, 1003)) and out[None].lang_pred == "aa"
    assert langid.accepted(docs(spark, rows + extra)).columns == docs(spark, rows).columns
    unlabelled = [(i, t, None, None) for i, t, *_ in rows[:5]]
    assert {r.lang_pred for r in langid.identify(docs(spark, unlabelled)).collect()} == {"und"}
    assert langid.identify(docs(spark, EMPTY)).count() == 0


def test_quality_counts(sample):
    for _, t, *_ in [*sample, (0, "a b c a b c d\nx\n x\nx\n\n##|", None, None)]:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + z for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[x] > 1 for z in range(3)}
        assert quality.statistics(t)[0] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)]


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] - 0.8 * x[:, 1] + 0.5 * np.sin(3 * x[:, 2]) + rng.normal(scale=0.5, size=3000) > 0).astype(float)
    model = quality.train(x, y, [1, -1, 0])
    assert ((model.score(x) > 0.5) == y).mean() > 0.8
    probe = rng.normal(size=(200, 3))
    for f, sign in ((0, 1), (1, -1)):
        scores = []
        for v in np.linspace(-3, 3, 40):
            p = probe.copy()
            p[:, f] = v
            scores.append(model.margin(p))
        assert (sign * np.diff(np.array(scores), axis=0) >= -1e-12).all()
    assert np.allclose(quality.train(x, np.ones(3000), [0, 0, 0]).score(x), quality.train(x, np.ones(3000), [0, 0, 0]).score(x[:1])[0])


def test_quality_query(spark, sample):
    labels = spark.createDataFrame([(i, int(len(t or "") > 60), 0) for i, t, *_ in sample if i is not None] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge_quality(docs(spark, sample), labels).collect()
    assert len(out) == len(sample)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.judge_quality(docs(spark, EMPTY), labels).count() == 0
    assert {r.score for r in quality.judge_quality(docs(spark, sample), labels.limit(0)).collect()} == {0.5}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_exact():
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))): rng.randint(0, 1) for _ in range(12)}
    stems = {"cabb", "bbbb"}
    machine = toxicity.LexiconAutomaton(words, stems)
    for _ in range(4000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 8)))
        want = toxicity.EXACT if w in words else toxicity.STEM if any(w.startswith(s) for s in stems) else toxicity.EDITED if any(e and edits(w, x) <= 1 for x, e in words.items()) else 0
        assert machine.match(w) == want, w
    assert toxicity.LexiconAutomaton({}, set()).match("a") == 0


def test_context_windows_tell_quotes_from_abuse():
    matches = toxicity._Matches(toxicity.LexiconAutomaton({"grumble": 1}, set()))
    abuse, quote = "you are a grumble today", 'the report quoted the word "grumble" from a letter'
    found = {t: toxicity.hits(t, matches) for t in (abuse, quote)}
    at = 8 * (toxicity.EXACT - 1)
    assert found[abuse][0][at + toxicity.ADDRESSED] == 1 and found[quote][0][at + toxicity.IN_QUOTES + toxicity.REPORTED] == 1
    # a mark without its partner quotes nothing, nor does one on another line
    assert toxicity.hits('a " grumble', matches)[0][at] == toxicity.hits('"a\ngrumble\nb"', matches)[0][at] == 1
    counts = np.array([found[abuse][0]] * 20 + [found[quote][0]] * 20)
    weights = toxicity.window_weights(counts, np.repeat([1.0, 0.0], 20))
    assert weights[at + toxicity.ADDRESSED] > 0.8 and weights[at + toxicity.IN_QUOTES + toxicity.REPORTED] < 0.2
    x = toxicity.features(counts, np.full(40, 9), weights)
    assert (x[:20, 0] > x[20:, 0]).all() and (x[:20, 5] < x[20:, 5]).all()
    assert toxicity.hits("grumbel gruble grumbble", matches)[0][8 * (toxicity.EDITED - 1)] == 2 and toxicity.hits(None, matches)[1] == 0


def test_automaton_forgets_states(monkeypatch):
    machine = toxicity.LexiconAutomaton({"grumble": 1}, {"abc"})
    monkeypatch.setattr(toxicity, "STATES", 5)
    for _ in range(3):
        assert [machine.match(w) for w in ("grumble", "grumbles", "abcde", "xyz")] == [toxicity.EXACT, toxicity.EDITED, toxicity.STEM, 0]
    assert len(machine.sets) < 60


def test_toxicity(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    bad = ["zzorkel", "vlimpet", "quaddle"]
    rows, marks = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "a"))
        marks.append((i, 1, int(toxic)))
    extra = [(500, "you zzorkell", None, None), (501, None, None, None), (502, "", None, None)]
    labels = spark.createDataFrame([*marks, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs(spark, rows + extra), labels).collect()}
    assert len(out) == 403
    for i, _, toxic in marks:
        assert out[i].predicted == toxic and out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert out[500].predicted == 1 and out[501].predicted == out[502].predicted == 0
    assert {r.score for r in toxicity.score_toxicity(docs(spark, rows[:5]), labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score_toxicity(docs(spark, EMPTY), labels).count() == 0

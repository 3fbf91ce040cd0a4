"""Near copies by the Jaccard similarity of word-shingle sets: prefix filtering and verification, nothing missed.

Each text is the set of the XXH64 values of its shingles, in one order for all texts, rare ones first. Two sets of n and m
items whose similarity is t or more share an item among the first n - ceil(t n) + 1 and m - ceil(t m) + 1: only these
prefixes are dealt out as postings. Pairs of a posting that sizes and positions allow are verified on the whole sets.
The order comes from a table of hashed counts of fixed size; it decides how long postings get, never what is found.

A posting of near copies would list the square of their number, and near copies meet in many postings. Large postings
therefore pair each member with its neighbour and with their centre only, the member with the fewest rarer items, and each
text verifies just two pairs at first: its nearest candidate of the fingerprint index that the caller gives, and the
partner that most postings name. Once these links are connected, only pairs that are still in different components go on;
after these, those that large postings had left out. Before whole sets are compared, sketches of a thousand bits that tell sets' parity in each slot bound from below how far they differ: a bound,
so no pair is lost. What connects is the same as if every pair had been verified.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, durable, parts

#: log2 of the counts in the table that orders shingles, and the number of slices it is added up in.
TABLE, SLICES = 20, 64
#: Above this many members a posting lists pairs in two rounds.
LARGE = 32
#: 64-bit words of a set's sketch.
WORDS = 16
#: log2 of the bits that tell which rows a join may need.
MARKS = 23
FOUND = "a long, b long, g long, n int, pos int"


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's word shingles.

    A-Z are lower-cased, words end at ASCII white space, fewer than ``width`` words make one shingle, none give none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    n, digest = len(words) - width + 1, xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n))


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def shingle_counts(docs: DataFrame, text: Column, width: int) -> np.ndarray:
    """How often shingles of each bucket (their lowest bits) occur, as 8 log2(count + 1) in a byte."""
    size = 1 << TABLE
    step = size // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(total, (shingles(t.as_py(), width) & np.uint64(size - 1)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([total[k * step : (k + 1) * step].tobytes() for k in range(SLICES)], pa.binary())], ["k", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(n.as_buffer(), np.int64)
        packed = [np.rint(8 * np.log2(n + 1.0)).clip(0, 255).astype(np.uint8).tobytes() for n in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], ["k", "n"])

    slices = docs.select(text.alias("t")).mapInArrow(count, "k int, n binary").repartition(min(SLICES, parts(docs.sparkSession)), "k").mapInArrow(add, "k int, n binary").collect()
    out = np.zeros(size, np.uint8)
    for r in slices:
        out[r.k * step : (r.k + 1) * step] = np.frombuffer(r.n, np.uint8)
    return out


def sketch(items: np.ndarray) -> np.ndarray:
    """Parity of the number of items in each of 64 x WORDS slots; sets that differ in d items differ in d slots at most."""
    odd = np.bincount(((items >> np.uint64(20)) & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix_of(counts: np.ndarray, fingerprint: Callable[[np.ndarray], int], width: int, similarity: float):
    """UDF of a text: ``key`` (64 bits of its whole shingle set), ``fp`` (its fingerprint), ``n`` (its size), ``prefix`` (rare items first), ``sketch``."""

    @F.pandas_udf("key long, fp long, n int, prefix binary, sketch array<long>")
    def udf(text: pd.Series) -> pd.DataFrame:
        key, fp, n, prefix, sketches = np.zeros(len(text), np.uint64), np.zeros(len(text), np.uint64), np.zeros(len(text), np.int32), [], []
        for k, t in enumerate(text):
            items = shingles(t, width)
            n[k] = len(items)
            key[k] = xxhash.xxh64_intdigest(items.tobytes()) if len(items) else 0
            fp[k] = fingerprint(items)
            rare = np.argsort(counts[(items & np.uint64(len(counts) - 1)).astype(np.int64)], kind="stable")
            sketches.append(sketch(items))
            prefix.append(items[rare[: prefix_length(len(items), similarity)]].tobytes() if len(items) else b"")
        return pd.DataFrame({"key": key.view(np.int64), "fp": fp.view(np.int64), "n": n, "prefix": prefix, "sketch": sketches})

    return udf


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One posting entry (g, key, n, pos) for each item of a prefix."""
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            items = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
            size = np.array([len(x) for x in items], np.int64)
            if not size.sum():
                continue
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in size])
            columns = np.concatenate(items), np.repeat(part.column(0).to_numpy(), size), np.repeat(part.column(1).to_numpy(), size), pos
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["g", "key", "n", "pos"])


def _batch(a, b=None, g=None, n=None, pos=None) -> pa.RecordBatch:
    none = lambda kind: pa.nulls(len(a), kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(a), none(pa.int64()) if b is None else pa.array(b), none(pa.int64()) if g is None else pa.array(g), none(pa.int32()) if n is None else pa.array(n), none(pa.int32()) if pos is None else pa.array(pos)],
        ["a", "b", "g", "n", "pos"],
    )


def pairs_of(similarity: float, across: bool):
    """Pairs of postings that come sorted by (g, key), with columns g, key, n, pos and, if ``across``, root and sketch.

    Small postings list all pairs. Large ones list each member with the next and with the centre, the one at the smallest
    ``pos``, and their members as they are (b null); ``across`` lists all pairs of members with different roots and
    sketches, a last column, that don't differ too much.
    """

    def fits(n, m, i, j):
        # items at and after the first common one bound the overlap
        n, m = n.astype(np.int64), m.astype(np.int64)
        return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (np.minimum(n - i, m - j) * (1 + similarity) >= similarity * (n + m) - 1e-9)

    def of(g, key, n, pos, *more) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(g)))
        run, length = np.cumsum(new) - 1, np.repeat(size, size)

        def listed(i, j):
            ok = (key[i] != key[j]) & fits(n[i], n[j], pos[i], pos[j])
            if across:
                ok &= more[0][i] != more[0][j]
            i, j = i[ok], j[ok]
            if across:
                far = np.bitwise_count(more[1][i] ^ more[1][j]).sum(axis=1)
                total = n[i].astype(np.int64) + n[j]
                ok = far <= total - 2 * np.ceil(similarity / (1 + similarity) * total - 1e-6)
                i, j = i[ok], j[ok]
            if len(i):
                yield _batch(np.minimum(key[i], key[j]), np.maximum(key[i], key[j]))

        todo = np.flatnonzero(length > 1 if across else (length > 1) & (length <= LARGE))
        for s in range(1, int(length[todo].max(initial=1))):
            # entries whose posting goes on for s more
            todo = todo[todo + s < len(g)]
            todo = todo[run[todo] == run[todo + s]]
            yield from listed(todo, todo + s)
        if not across and len(big := np.flatnonzero(length > LARGE)):
            later = big[~new[big]]
            yield from listed(later, later - 1)
            # sorted by posting and pos, the first of each posting is its centre
            first = np.lexsort((pos, run))[at]
            yield from listed(big, first[run[big]])
            yield _batch(key[big], None, g[big], n[big], pos[big])

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy() for c in b.columns[:5]]
            if across:
                cols.append(b.column(5).flatten().to_numpy().reshape(-1, WORDS))
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            # what may go on in the next batch waits
            upto = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [x[upto:] for x in cols]
            if upto:
                yield from of(*(x[:upto] for x in cols))
        if held is not None:
            yield from of(*held)

    return all_of


def may_be_among(tags: DataFrame):
    """UDF of a tag: false only if it is none of ``tags(k)``. Rows that can't be in a join with them need no shuffle.

    The bits have a fixed size: with more tags than that, more rows are shuffled, and none is lost.
    """
    x = F.pmod("k", F.lit(1 << MARKS)) + 1
    slices = tags.groupBy(F.bitmap_bucket_number(x).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).collect()
    packed = np.zeros(1 << (MARKS - 3), np.uint8)
    for r in slices:
        packed[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], np.uint8)

    @F.pandas_udf("boolean")
    def udf(tag: pd.Series) -> pd.Series:
        i = tag.to_numpy() & ((1 << MARKS) - 1)
        return pd.Series((packed[i >> 3] >> (i & 7) & 1).astype(bool))

    return udf


def rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the root of their ``key`` among the components ``found(node, root)``; a key without links is its own."""
    return rows.join(found, rows["key"] == found["node"], "left").withColumn("root", F.coalesce("root", "key")).drop("node")


def resembling(
    docs: DataFrame,
    tagged: list[Column],
    text: Column,
    fingerprint: Callable[[np.ndarray], int],
    candidates: Callable[[DataFrame], DataFrame],
    width: int = 5,
    similarity: float = 0.8,
) -> DataFrame:
    """Every row as ``tagged`` columns (one named tag, that stands for its text at least) and ``root``.

    ``candidates`` names pairs ``(a, b, bits)`` of ``(key, fp)``, ``fp`` being the ``fingerprint`` of a shingle set. Each
    text's nearest is verified first; the result doesn't hang on how many it names.

    Rows have the same root iff a chain of shingle sets, each of Jaccard similarity ``similarity`` or more to the next,
    connects their texts. Texts without words are alike. An empty table gives no rows.
    """
    many = parts(docs.sparkSession)
    udf = prefix_of(shingle_counts(docs, text, width), fingerprint, width, similarity)
    rows = durable(docs.select(*tagged, udf(text).alias("s")).select("*", "s.*").drop("s"))
    entries = rows.select("key", "n", "prefix").mapInArrow(_spread, "g long, key long, n int, pos int")
    found = durable(entries.repartition(many, "g").sortWithinPartitions("g", "key").mapInArrow(pairs_of(similarity, False), FOUND))
    members = found.where("b is null").select("g", F.col("a").alias("key"), "n", "pos")
    pairs = durable(found.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("named")))

    # each text's nearest candidate of the index, and the partner that most postings name: two pairs a text at most
    near = durable(candidates(rows.groupBy("key").agg(F.first("fp").alias("fp")))).select("a", "b", F.lit(None).cast("long").alias("named"), (-F.col("bits")).alias("alike"))
    both = pairs.withColumn("alike", F.lit(None).cast("int")).unionByName(near)
    both = both.select(F.col("a").alias("t"), F.col("b").alias("other"), "named", "alike").unionByName(both.select(F.col("b").alias("t"), F.col("a").alias("other"), "named", "alike"))
    best = both.groupBy("t").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct(c, "other")))["other"].alias(c) for c in ("named", "alike")])
    best = best.select("t", F.explode(F.array("named", "alike")).alias("other")).where("other is not null")
    low = durable(best.select(F.least("t", "other").alias("a"), F.greatest("t", "other").alias("b")).distinct())
    both = pairs.select("a", "b").unionByName(low)
    wanted = both.select(F.col("a").alias("key")).unionByName(both.select(F.col("b").alias("key"))).unionByName(members.select("key")).distinct()
    tags = durable(rows.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("tag").alias("k")))
    whole = docs.select(*tagged, text.alias("whole_text")).select("tag", "whole_text").where(may_be_among(tags)("tag")).join(tags, F.col("tag") == F.col("k")).dropDuplicates(["tag"])

    @F.pandas_udf("array<long>")
    def items(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(t, width).view(np.int64))

    sets = durable(whole.select("key", items("whole_text").alias("items")))

    sketches = durable(rows.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    def verified(some: DataFrame) -> DataFrame:
        """Pairs whose sketches allow the similarity and whose sets have it."""
        thin = some
        for side in ("a", "b"):
            thin = thin.join(sketches.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
        total = F.col("n_a") + F.col("n_b")
        far = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        near = thin.where(far <= total - 2 * F.ceil(F.lit(similarity / (1 + similarity)) * total - 1e-6)).select("a", "b")
        x, y = sets.select(F.col("key").alias("a"), F.col("items").alias("x")), sets.select(F.col("key").alias("b"), F.col("items").alias("y"))
        shared = F.size(F.array_intersect("x", "y"))
        return near.join(x, "a").join(y, "b").where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")

    def apart(some: DataFrame) -> DataFrame:
        """Pairs whose texts aren't connected yet."""
        met = some
        for side in ("a", "b"):
            met = met.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
        return met.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")

    links = durable(verified(low))
    roots = components(links)
    more = durable(verified(apart(pairs).join(low, ["a", "b"], "left_anti")))
    if not more.isEmpty():
        links = durable(links.unionByName(more))
        roots = components(links)
    if not members.isEmpty():
        placed = rooted(members, roots).join(sketches.select("key", "sketch"), "key").select("g", "key", "n", "pos", "root", "sketch")
        placed = placed.repartition(many, "g").sortWithinPartitions("g", "key")
        listed = placed.mapInArrow(pairs_of(similarity, True), FOUND).select("a", "b").distinct()
        more = durable(verified(listed.join(pairs, ["a", "b"], "left_anti")))
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    return rooted(rows, roots).drop("key", "fp", "n", "prefix", "sketch")

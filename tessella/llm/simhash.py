"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most two bits share at least six of their eight positional bytes: that is
the count a pair must reach. The index lists fingerprints under (position, byte). Such postings hold one in 256 of all
fingerprints each, so they are cut down by further positions: as only two of eight bytes may differ, the first four
that a pair shares are among its first six positions, and a posting of four of these (15 a fingerprint) holds every
pair that counts. In a posting the shared positional bytes of each pair are tallied; pairs that share six or more are
retained and verified by their bits. Postings that are too large to list their pairs are cut down by two positions
more, again as count filtering allows. These hold at most 65,536 fingerprints that differ in two bytes only, and are
searched by flipping one or two of the sixteen free bits and looking the result up.

Near-dedup (``keep_one``) asks the same kind of index for texts of similar shingle sets: fingerprints of the sets, a lower
count and more bits. No count of bytes can promise all of these, so the index gives candidates: those whose whole sets are
similar are linked, and ``resemblance`` finds the pairs that it missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import components, durable, parts, row_tag, shuffles_freed
from .resemblance import may_be_among, resembling

BYTES, SHARED, BITS = 8, 6, 2
#: Shared positions that a posting fixes at first, and in the second round.
FIXED, REFINED = 4, 6
#: Postings above this many members don't list pairs.
LARGE = 32
#: Of candidates for similar shingle sets: positional bytes that they share, those that a posting fixes, and their bits at most.
#: Similarity 0.8 of sets means 9.7 bits of 64 on average, with a deviation of 2.9.
NEAR_SHARED, NEAR_FIXED, NEAR_BITS = 4, 3, 16


def _counts(h: np.ndarray) -> np.ndarray:
    """In how many of some 64-bit values each bit is set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint_of(items: np.ndarray) -> int:
    """SimHash of a set of 64-bit values; 0 if it is empty."""
    return _majority(_counts(items), len(items))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles, repeats included: bit i is set if it is in over half of their XXH64 values.

    A-Z are lower-cased, words end at ASCII white space, fewer than ``width`` words make one shingle, none give 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    n, digest = len(words) - width + 1, xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    block = 1 << 16
    for at in range(0, n, block):
        upto = min(n, at + block)
        spans = zip(starts[at:upto].tolist(), ends[at + width - 1 : upto + width - 1].tolist(), strict=True)
        h = np.fromiter((digest(joined[i:j], seed) for i, j in spans), np.uint64, upto - at)
        counts += _counts(h)
    return _majority(counts, n)


@F.pandas_udf(LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], np.uint64).view(np.int64))


def _mask(positions: tuple[int, ...]) -> int:
    """The 64-bit mask of some byte positions, as a signed number."""
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def masks(fixed: int, given: tuple[int, ...] = ()) -> list[int]:
    """Masks of ``fixed`` byte positions, ``given`` ones among them, one of which any pair that reaches the count shares.

    Of the positions that aren't given a pair lacks at most BYTES - SHARED, so its first shared ones lie at the front.
    """
    rest = [p for p in range(BYTES) if p not in given]
    more = fixed - len(given)
    return [_mask((*given, *x)) for x in combinations(rest[: more + BYTES - SHARED], more)]


def _free_bits(mask: int) -> np.ndarray:
    return np.array([1 << b for b in range(64) if not mask >> b & 1], np.uint64)


def _large(fps: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links inside one large posting; ``fps`` is sorted and distinct."""
    bits = _free_bits(mask)
    flips = [*bits, *(x | y for x, y in combinations(bits, 2))]
    near = []
    for f in flips:
        want = fps ^ f
        at = np.minimum(np.searchsorted(fps, want), len(fps) - 1)
        hit = np.flatnonzero((fps[at] == want) & (want < fps))
        near.append((hit, at[hit]))
    i, j = (np.concatenate(x) for x in zip(*near, strict=True))
    root = np.arange(len(fps))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if np.array_equal(low, root):
            break
        root = low
    at = np.flatnonzero(root != np.arange(len(fps)))
    return fps[at], fps[root[at]]


def _links(refined: bool):
    """Of postings that come sorted by (mask, values), with columns mask, values, fp: verified links (a, b).

    In the first round large postings give their members instead (a, mask), as they come; ``refined`` ones are searched.
    """

    def rows(a: np.ndarray, b: np.ndarray | None = None, mask: np.ndarray | None = None) -> pa.RecordBatch:
        columns = [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (a, b, mask)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "mask"])

    def of(mask: np.ndarray, values: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(fp), bool)
        new[1:] = (mask[1:] != mask[:-1]) | (values[1:] != values[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(fp)))
        run, length = np.cumsum(new) - 1, np.repeat(size, size)
        small = np.flatnonzero((length > 1) & (length <= LARGE))
        for s in range(1, int(min(LARGE, length.max(initial=1)))):
            i = small[small + s < len(fp)]
            i = i[run[i] == run[i + s]]
            if not len(i):
                break
            diff = fp[i] ^ fp[i + s]
            tally = (diff.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            i, diff = i[tally >= SHARED], diff[tally >= SHARED]
            i = i[np.bitwise_count(diff) <= BITS]
            if len(i):
                yield rows(fp[i + s], fp[i])
        if not refined and (large := length > LARGE).any():
            yield rows(fp[large], None, mask[large])
        for g in np.flatnonzero(size > LARGE) if refined else ():
            x, y = _large(np.unique(fp[at[g] : at[g] + size[g]]), int(mask[at[g]]))
            if len(x):
                yield rows(x, y)

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            cols[2] = cols[2].view(np.uint64)
            if large is not None:
                # more members of the posting that has proved to be large
                n = int(np.argmin(np.append((cols[0] == large[0]) & (cols[1] == large[1]), False)))
                if n:
                    yield rows(cols[2][:n], None, cols[0][:n])
                    cols = [x[n:] for x in cols]
                if not len(cols[0]):
                    continue
                large = None
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            # what may go on in the next batch waits
            other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            upto = int(other[-1]) + 1 if len(other) else 0
            held = [x[upto:] for x in cols]
            if upto:
                yield from of(*(x[:upto] for x in cols))
            if not refined and len(held[0]) > LARGE:
                yield rows(held[2], None, held[0])
                large, held = (held[0][0], held[1][0]), None
        if held is not None:
            yield from of(*held)

    return all_of


def linked(fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fps(fp)`` at two or fewer differing bits, enough to connect each component."""
    width = parts(fps.sparkSession)

    def searched(entries: DataFrame, refined: bool) -> DataFrame:
        values = F.col("fp").bitwiseAND(F.col("mask"))
        dealt = entries.select("mask", values.alias("values"), "fp").repartition(width, "mask", "values").sortWithinPartitions("mask", "values")
        return dealt.mapInArrow(_links(refined), "a long, b long, mask long")

    first = {m: tuple(p for p in range(BYTES) if m >> (8 * p) & 1) for m in masks(FIXED)}
    found = durable(searched(fps.select("fp", F.explode(F.array(*map(F.lit, first))).alias("mask")), False))
    finer = F.coalesce(*[F.when(F.col("mask") == m, F.array(*map(F.lit, masks(REFINED, given)))) for m, given in first.items()])
    members = found.where("b is null").select(F.col("a").alias("fp"), F.explode(finer).alias("mask")).distinct()
    return found.where("b is not null").select("a", "b").unionByName(searched(members, True).select("a", "b"))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, fp) the entries (slot, fp, key) of the candidates' index; a slot stands for positions and their bytes."""
    fixed = list(combinations(range(NEAR_FIXED + BYTES - NEAR_SHARED), NEAR_FIXED))
    for b in batches:
        key, fp = (c.to_numpy() for c in b.columns)
        part = fp.view(np.uint8).reshape(-1, BYTES).astype(np.int32)
        for k, positions in enumerate(fixed):
            slot = np.full(len(fp), k, np.int32)
            for p in positions:
                slot = slot << 8 | part[:, p]
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(fp), pa.array(key)], ["slot", "fp", "key"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b, bits) of postings that come sorted by (slot, fp); large ones pair neighbours in this order only."""

    def of(slot: np.ndarray, fp: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(slot), bool)
        new[1:] = slot[1:] != slot[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(slot)))
        run, length = np.cumsum(new) - 1, np.repeat(size, size)
        todo = np.flatnonzero(length > 1)
        for s in range(1, int(min(LARGE, length.max(initial=1)))):
            if s > 1:
                todo = todo[length[todo] <= LARGE]
            todo = todo[todo + s < len(slot)]
            todo = todo[run[todo] == run[todo + s]]
            diff = fp[todo] ^ fp[todo + s]
            bits = np.bitwise_count(diff.view(np.uint64)).astype(np.int32)
            tally = (diff.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            ok = (tally >= NEAR_SHARED) & (bits <= NEAR_BITS)
            x, y = key[todo[ok]], key[todo[ok] + s]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(bits[ok])], ["a", "b", "bits"])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy() for c in b.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        # what may go on in the next batch waits
        upto = int(np.searchsorted(cols[0], cols[0][-1]))
        held = [x[upto:] for x in cols]
        if upto:
            yield from of(*(x[:upto] for x in cols))
    if held is not None:
        yield from of(*held)


def candidates(fps: DataFrame) -> DataFrame:
    """Candidates ``(a, b, bits)`` among ``fps(key, fp)``, one fingerprint a key: NEAR_BITS or fewer differing bits, NEAR_SHARED or more shared bytes.

    Postings above LARGE members give each member the next by fingerprint instead of all pairs. A pair may be named repeatedly.
    """
    entries = fps.select("key", "fp").mapInArrow(_postings, "slot int, fp long, key long")
    dealt = entries.repartition(parts(fps.sparkSession), "slot").sortWithinPartitions("slot", "fp", "key")
    return dealt.mapInArrow(_near, "a long, b long, bits int")


def _rooted(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` with the root of their ``key`` among the components ``found(node, root)``; a key without links is its own."""
    return rows.join(found, rows[key] == found["node"], "left").withColumn("root", F.coalesce("root", key)).drop("node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: doc_id, fp (signed), component_id.

    component_id is the smallest doc_id reachable over links of fingerprints at two or fewer differing bits, itself
    included; null identifiers count as largest. Null, empty and blank texts have fingerprint zero, which links like any other. Copies meet as
    one fingerprint before anything is indexed. Repeated rows are all returned; an empty table gives no rows; other
    columns are ignored.
    """
    rows = durable(docs.select(docs[id_col].alias("doc_id"), fingerprint_udf(docs[text_col]).alias("fp")))
    firsts = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    classes = _rooted(firsts, components(linked(firsts.select("fp"))), "fp")
    lowest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = classes.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of near copies, with the columns of ``docs`` as they were.

    SimHash fingerprints of the shingle sets name candidates through the byte-position index; whole sets decide, and pairs
    that the index missed are found by prefixes of the sets, so that every link counts. Near copies have sets of ``width``-word shingles of Jaccard similarity ``similarity`` or more (the two bits of the
    fingerprints are the contract of ``near_duplicates`` alone). The row that stays has the smallest identifier, null
    identifiers last, and of those the text with the smallest hash. Identifiers only order the rows of a component: rows
    of different components that share one, or have none, all stay. Of rows that repeat identifier and text one stays.
    """
    doc_id, text = docs[id_col], docs[text_col]
    tag = row_tag(doc_id, text).alias("tag")
    with shuffles_freed(docs.sparkSession):
        classes = durable(resembling(docs, [doc_id.alias("doc_id"), F.xxhash64(text).alias("h"), tag], text, fingerprint_of, candidates, width, similarity))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "tag"))
        shared = durable(classes.groupBy("root").agg(F.count("*").alias("rows"), first.alias("row")).where("rows > 1"))
        # rows alone in their component stay as they are, the others are looked up
        doubtful = may_be_among(durable(classes.join(shared, "root", "left_semi").select(F.col("tag").alias("k")).distinct()))
    stays = classes.join(shared, "root", "left").select(F.coalesce("row.tag", "tag").alias("k")).distinct()
    wide = docs.select(F.struct("*").alias("row"), tag)
    chosen = wide.where(doubtful("tag")).join(stays, F.col("tag") == F.col("k")).dropDuplicates(["tag"])
    return wide.where(~doubtful("tag")).select("row.*").unionByName(chosen.select("row.*"))


def hex16(fp) -> "F.Column":
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

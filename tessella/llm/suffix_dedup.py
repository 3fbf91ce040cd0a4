"""Repeated passages: per-shard suffix arrays, and a merge of shards by binary search.

A byte goes if a string of ``width`` (50) bytes that covers it also starts in a document with a smaller identifier.

1. Copies: a text equal to that of a smaller document goes whole, so only the first document of each text is searched.
   Digests and identifiers decide which one that is; the bytes of a text with very many copies travel once.
2. Anchors: in each window of ``width`` bytes the ``gram`` bytes with the smallest hash are its anchor. Equal windows
   have equal anchors, so only windows whose anchor occurs in two documents can repeat. Every part of the corpus sends
   its anchors as sorted runs; slices of the hash space are merged by binary search and tell each part which of its
   anchors occur elsewhere. This drops the bulk of the text and no possible match.
3. Suffix arrays: the stretches around the remaining anchors are dealt to shards by anchor. A shard orders all suffixes
   of its stretches by Larsson-Sadakane refinement (sort by the first bytes, then double the depth, sorting only groups
   that are still tied), gets common prefixes by Kasai's rule that they shrink by one at most from a position to the
   next, and so finds the runs of equal windows. All but a run's smallest document lose the window.
4. Merging: an anchor shared by very many documents is dealt to several shards; each leaves its runs' smallest documents
   in doubt. Its suffix order gives these windows as sorted runs, which are merged in shards by window: the places of
   one run in another are found by binary search, in rounds like a tournament.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, parts, stored

#: Odd multiplier of the rolling hash and its inverse modulo 2^64.
MULT = 0x9E3779B97F4A7C15
INVERSE = pow(MULT, -1, 1 << 64)
#: Bits of a position inside a block; blocks are shorter than 2^17 bytes.
PLACE = 17
BLOCK, PIECE = 1 << PLACE, 90_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


UP, DOWN = _powers(MULT, BLOCK), _powers(INVERSE, BLOCK)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of every ``gram`` consecutive bytes, from prefix sums of a polynomial modulo 2^64."""
    n = len(b)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * UP[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * DOWN[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def window_anchors(h: np.ndarray, span: int) -> np.ndarray:
    """Where the smallest of each ``span`` consecutive hashes stands; of equal ones the leftmost."""
    low = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    return (low & np.uint64(BLOCK - 1)).astype(np.int64)


@dataclass
class Stretches:
    """Windows of one block that have one anchor: ``first`` .. ``last`` are window starts in the block's bytes."""

    b: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    start: np.ndarray
    anchor: np.ndarray


def stretches_of(texts: list, width: int, gram: int) -> Iterator[Stretches]:
    """All windows of all texts (bytes), in stretches; ``doc`` is the text's number, ``start`` the first window's place in it."""

    def block(pieces: list[tuple[int, int, np.ndarray]]) -> Stretches | None:
        b = np.concatenate([x for _, _, x in pieces])
        lengths = np.array([len(x) for _, _, x in pieces])
        begin = np.cumsum(lengths) - lengths
        h = gram_hashes(b, gram)
        at = window_anchors(h, width - gram + 1)
        piece = np.repeat(np.arange(len(pieces)), lengths)[: len(at)]
        ok = np.arange(len(at)) + width <= (begin + lengths)[piece]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])
        # windows across pieces are at the end of a piece, so that they only cut off a stretch's end
        first = np.flatnonzero(new & ok)
        ends = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True))
        if not len(first):
            return None
        own = piece[first]
        docs, offsets = (np.array([x[k] for x in pieces], np.int64) for k in (0, 1))
        # the smallest of many hashes is small; mixed anew, anchors are spread evenly over the slices of the hash space
        anchor = h[at[first]] * np.uint64(MULT)
        anchor ^= anchor >> np.uint64(32)
        anchor *= np.uint64(MULT)
        return Stretches(b, docs[own], first, ends, first - begin[own] + offsets[own], anchor)

    pieces, size = [], 0
    for i, t in enumerate(texts):
        b = np.frombuffer(t, np.uint8)
        for off in range(0, max(len(b) - width + 1, 0), PIECE - width + 1):
            x = b[off : off + PIECE]
            if size + len(x) >= BLOCK:
                if (out := block(pieces)) is not None:
                    yield out
                pieces, size = [], 0
            pieces.append((i, off, x))
            size += len(x)
    if pieces and (out := block(pieces)) is not None:
        yield out


def _sevens(text: np.ndarray) -> np.ndarray:
    """Seven symbols from each position on in one number that orders like them; symbols are below 512, past the end is 0."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : n + k]
    return key


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` symbols.

    Larsson-Sadakane: groups carry the rank of their first member; each pass sorts the members of tied groups by the
    rank ``h`` further on and doubles ``h``.
    """
    n = len(text)
    key = _sevens(text)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + depth + 8, np.int64)
    rank[n:] = -1
    rank[order] = start
    h = 7
    while h < depth:
        size = np.diff(np.append(np.flatnonzero(new), n))
        tied = np.flatnonzero(np.repeat(size, size) > 1)
        if not len(tied):
            break
        at = order[tied]
        # 7, 14, 28, 49+: the last step looks no further than depth
        ahead = min(h, depth - h)
        resort = np.lexsort((rank[at + ahead], rank[at]))
        at = at[resort]
        order[tied] = at
        group, further = rank[at], rank[at + ahead]
        split = np.ones(len(at), bool)
        split[1:] = (group[1:] != group[:-1]) | (further[1:] != further[:-1])
        new[tied] |= split
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[tied]] = start[tied]
        h += ahead
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, every: int = 16) -> np.ndarray:
    """Common prefix with the suffix before in ``order``, at most ``depth``, for every position of ``text``.

    Kasai's rule: it falls by one at most from a position to the next. Suffixes are ordered to ``depth`` only, so the
    rule holds after a prefix shorter than that. Every ``every``-th position is compared from scratch, all at once; the
    others start from what the rule guarantees and go on comparing, first seven symbols at a time, then one.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    sevens = np.concatenate([_sevens(text), np.zeros(depth + 8, np.uint64)])
    out = np.zeros(n, np.int64)
    for lane in range(min(every, n)):
        at = np.arange(lane, n, every)
        known = np.zeros(len(at), np.int64)
        if lane:
            last = out[at - 1]
            known = np.where(last < depth, np.maximum(last - 1, 0), 0)
        other = before[at]
        for stride, shift in ((7, 0), (1, 54)):
            live = np.flatnonzero((other >= 0) & (known < depth))
            while len(live):
                i, j = at[live] + known[live], other[live] + known[live]
                x, y = sevens[i] >> np.uint64(shift), sevens[j] >> np.uint64(shift)
                live = live[(x == y) & (x != 0)]
                known[live] += stride
                live = live[known[live] < depth]
        out[at] = np.minimum(known, depth)
    return out


def equal_windows(stretches: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of all stretches: stretch, start in it, and a number that equal windows share."""
    lengths = np.array([len(s) + 1 for s in stretches], np.int64)
    # bytes plus one, and a zero after each stretch
    text = np.zeros(int(lengths.sum()), np.int16)
    begin = np.cumsum(lengths) - lengths
    inside = np.ones(len(text), bool)
    inside[begin + lengths - 1] = False
    text[inside] = np.frombuffer(b"".join(stretches), np.uint8).astype(np.int16) + 1
    owner = np.repeat(np.arange(len(stretches)), lengths)
    order = suffix_array(text, width)
    prefix = common_prefixes(text, order, width)[order]
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(prefix < width)
    local = np.arange(len(text)) - begin[owner]
    at = np.flatnonzero(local + width <= lengths[owner] - 1)
    return owner[at], local[at], group[at]


# --- the four steps as functions of Arrow tables ---

RAW = "digest binary, part int, doc_id long, b binary"
RUN = "slice int, part int, hashes binary, docs binary"
STRETCH = "shard int, part int, uids binary, doc_ids binary, starts binary, lengths binary, anchors binary, totals binary, b binary"
GONE = "part int, uid long, first long, last long"
#: Either a lost run, or the windows that a shard of a hot anchor leaves in doubt.
JUDGED = GONE + ", shard int, windows binary, parts binary, uids binary, doc_ids binary, starts binary"
DONE = "digest binary, first long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _uid(digest: bytes) -> int:
    return int.from_bytes(digest[8:16], "little", signed=True)


def _trimmed(step):
    """``step`` on one table, after which a worker hands the memory it has freed back to the system; workers outlive tasks."""

    def run(t: pa.Table) -> pa.Table:
        out = step(t)
        give_back()
        return out

    return run


def _trimmed_pair(step):
    """The same for a step on two tables."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = step(a, b)
        give_back()
        return out

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def _local_firsts(n: int, known: dict[bytes, int]):
    """Of each text in a task, one row with its bytes; further rows without bytes only for smaller identifiers.

    Of texts whose first document is ``known`` only that document's row goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary())

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["digest", "part", "doc_id", "b"])

        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = t.as_buffer() if t.is_valid else b""
                d = hashlib.sha256(b).digest()
                if known.get(d, doc) != doc:
                    continue
                seen = least.get(d)
                if seen is None or doc < seen:
                    least[d] = doc
                    rows.append((d, int.from_bytes(d[:6], "little") % n, doc, bytes(b) if seen is None else None))
                    size += len(b)
                if size > 1 << 22:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)
            give_back()

    return run


def _firsts(t: pa.Table) -> list[tuple[bytes, int, memoryview]]:
    """(digest, smallest identifier, bytes) of every text of a part; the bytes aren't copied."""
    least: dict[bytes, int] = {}
    text: dict[bytes, memoryview] = {}
    for d, doc, b in zip(t["digest"].to_pylist(), t["doc_id"].to_pylist(), t["b"], strict=True):
        least[d] = min(least.get(d, doc), doc)
        if b.is_valid and d not in text:
            text[d] = memoryview(b.as_buffer())
    return [(d, least[d], text[d]) for d in sorted(least)]


def _anchor_runs(width: int, gram: int, slices: int):
    @_trimmed
    def run(t: pa.Table) -> pa.Table:
        texts = [b for _, _, b in _firsts(t)]
        hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for s in stretches_of(texts, width, gram):
            hashes.append(s.anchor)
            docs.append(s.doc)
        h, d = np.concatenate(hashes), np.concatenate(docs)
        o = np.lexsort((d, h))
        h, d = h[o], d[o]
        one = np.ones(len(h), bool)
        one[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h = h[one]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(new)
        many = np.diff(np.append(at, len(h))).astype("<u4")
        h = h[at]
        edge = np.searchsorted(h, _slice_edges(slices))
        rows = [(k, h[i:j].astype("<u8").tobytes(), many[i:j].tobytes()) for k, (i, j) in enumerate(zip(edge, np.append(edge[1:], len(h)), strict=True)) if j > i]
        part = t["part"][0].as_py()
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["slice", "part", "hashes", "docs"])

    return run


def _slice_edges(slices: int) -> np.ndarray:
    return np.array([(1 << 64) * k // slices for k in range(slices)], np.uint64)


@_trimmed
def _shared_anchors(t: pa.Table) -> pa.Table:
    """Merges a slice's sorted runs: each part gets back its anchors of two documents or more, with how many there are."""
    runs = [np.frombuffer(x, "<u8") for x in t["hashes"].to_pylist()]
    docs = [np.frombuffer(x, "<u4") for x in t["docs"].to_pylist()]
    h = np.concatenate(runs)
    o = np.argsort(h, kind="stable")
    h, many = h[o], np.concatenate(docs)[o].astype(np.int64)
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    total = np.add.reduceat(many, at)
    shared, total = h[at][total > 1], total[total > 1]
    rows = []
    for r, part in zip(runs, t["part"].to_pylist(), strict=True):
        if not len(shared):
            break
        where = np.minimum(np.searchsorted(shared, r), len(shared) - 1)
        hit = where[shared[where] == r]
        if len(hit):
            rows.append((part, shared[hit].tobytes(), np.minimum(total[hit], 2**32 - 1).astype("<u4").tobytes()))
    k = t["slice"][0].as_py()
    return pa.table([pa.array([k] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["slice", "part", "hashes", "docs"])


def _cut_stretches(width: int, gram: int, shards: int, hot: int):
    @_trimmed_pair
    def run(texts: pa.Table, shared: pa.Table) -> pa.Table:
        order = np.argsort(shared["slice"].to_numpy(), kind="stable")
        blobs, counts = shared["hashes"].to_pylist(), shared["docs"].to_pylist()
        known = np.frombuffer(b"".join(blobs[i] for i in order), "<u8")
        total = np.frombuffer(b"".join(counts[i] for i in order), "<u4")
        out: list[list[np.ndarray]] = []
        chunks: list[np.ndarray] = []
        if len(known) and texts.num_rows:
            found = _firsts(texts)
            uid, doc_id = np.array([_uid(d) for d, _, _ in found], np.int64), np.array([i for _, i, _ in found], np.int64)
            for s in stretches_of([b for _, _, b in found], width, gram):
                where = np.minimum(np.searchsorted(known, s.anchor), len(known) - 1)
                hit = np.flatnonzero(known[where] == s.anchor)
                if not len(hit):
                    continue
                many, doc = total[where[hit]].astype(np.int64), s.doc[hit]
                length = s.last[hit] + width - s.first[hit]
                salt = np.abs(uid[doc]) % np.maximum(1, -(-many // hot))
                with np.errstate(over="ignore"):
                    shard = ((s.anchor[hit] ^ (salt.astype(np.uint64) * np.uint64(MULT))) >> np.uint64(7)) % np.uint64(shards)
                place = np.repeat(s.first[hit] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
                chunks.append(s.b[place])
                out.append([shard.astype(np.int64), uid[doc], doc_id[doc], s.start[hit], length, s.anchor[hit], many])
        rows = []
        if out:
            shard, *cols = (np.concatenate(x) for x in zip(*out, strict=True))
            text = np.concatenate(chunks)
            length = cols[3]
            begin = np.cumsum(length) - length
            o = np.lexsort((cols[4], shard))
            edge = np.flatnonzero(np.append(True, shard[o][1:] != shard[o][:-1]))
            for i, j in zip(edge, np.append(edge[1:], len(o)), strict=True):
                pick = o[i:j]
                n = length[pick]
                place = np.repeat(begin[pick] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                kinds = ("<i8", "<i8", "<i8", "<u2", "<u8", "<u4")
                rows.append((int(shard[pick[0]]), *(c[pick].astype(k).tobytes() for c, k in zip(cols, kinds, strict=True)), text[place].tobytes()))
        part = texts["part"][0].as_py() if texts.num_rows else 0
        names = ["shard", "part", "uids", "doc_ids", "starts", "lengths", "anchors", "totals", "b"]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 8))], names)

    return run


def _intervals(part: np.ndarray, uid: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Byte runs ``first`` .. ``last`` (exclusive) of texts, joined where they touch or overlap."""
    o = np.lexsort((first, uid, part))
    part, uid, first, last = (x[o] for x in (part, uid, first, last))
    other = np.ones(len(o), bool)
    other[1:] = (part[1:] != part[:-1]) | (uid[1:] != uid[:-1])
    # texts one behind another on one axis, so that a running maximum never reaches into the next text
    far = (np.cumsum(other) - 1) * (int(last.max(initial=0)) + 2)
    reach = np.maximum.accumulate(last + far)
    new = np.ones(len(o), bool)
    new[1:] = other[1:] | ((first + far)[1:] > reach[:-1])
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(o)) - 1 if len(o) else at
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(uid[at]), pa.array(first[at]), pa.array((reach - far)[end])], ["part", "uid", "first", "last"])


@dataclass
class _Shard:
    """One shard's stretches, sorted by anchor."""

    part: np.ndarray
    uid: np.ndarray
    doc_id: np.ndarray
    start: np.ndarray
    length: np.ndarray
    anchor: np.ndarray
    total: np.ndarray
    texts: list[bytes]

    @classmethod
    def of(cls, t: pa.Table) -> _Shard:
        def col(name: str, kind: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, kind) for x in t[name].to_pylist()])

        length = col("lengths", "<u2").astype(np.int64)
        n = [len(x) // 8 for x in t["uids"].to_pylist()]
        part = np.repeat(t["part"].to_numpy(), n)
        whole = b"".join(t["b"].to_pylist())
        end = np.cumsum(length)
        anchor = col("anchors", "<u8")
        o = np.argsort(anchor, kind="stable")
        begin, stop = (end - length)[o].tolist(), end[o].tolist()
        return cls(part[o], col("uids", "<i8")[o], col("doc_ids", "<i8")[o], col("starts", "<i8")[o], length[o], anchor[o], col("totals", "<u4")[o].astype(np.int64), [whole[i:j] for i, j in zip(begin, stop, strict=True)])


def _judge_shard(width: int, chunk: int, most: int, shards: int):
    """Lost byte runs of a shard, and the windows of anchors of over ``most`` documents that other shards may still beat.

    Anchors are judged in chunks of about ``chunk`` bytes of distinct stretches; all that a chunk leaves is a few numbers
    for each run, and sorted arrays of the windows in doubt.
    """

    @_trimmed
    def run(t: pa.Table) -> pa.Table:
        s = _Shard.of(t)
        lost: list[tuple[np.ndarray, ...]] = []
        doubt: list[tuple] = []  # shard of the merge, then blobs as in JUDGED
        edge = np.append(np.flatnonzero(np.append(True, s.anchor[1:] != s.anchor[:-1])), len(s.anchor))
        texts: list[bytes] = []  # distinct stretches of the chunk
        least: list[int] = []
        hot: list[bool] = []
        holders: list[list[int]] = []  # rows that have the stretch at its smallest document

        def held_by(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """For each place of ``owner`` all rows that hold its stretch: the places, repeated, and the rows."""
            n = np.array([len(h) for h in holders], np.int64)
            rows = np.concatenate([np.asarray(h, np.int64) for h in holders])
            many = n[owner]
            place = np.repeat(np.arange(len(owner)), many)
            return place, rows[np.repeat((np.cumsum(n) - n)[owner] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]

        def leave_in_doubt(owner: np.ndarray, local: np.ndarray, group: np.ndarray) -> None:
            place, row = held_by(owner)
            o = np.argsort(group[place], kind="stable")  # groups are numbered in the order of their windows
            place, row = place[o], row[o]
            whole = np.frombuffer(b"".join(texts), np.uint8)
            begin = np.cumsum([0, *map(len, texts)])[:-1]
            windows = whole[(begin[owner] + local)[place][:, None] + np.arange(width)]
            mixed = np.zeros(len(windows), np.uint64)
            for k in range(width):
                mixed = (mixed ^ windows[:, k]) * np.uint64(MULT)
            shard = (mixed >> np.uint64(20)) % np.uint64(shards)
            start = s.start[row] + local[place]
            for k in np.unique(shard).tolist():
                mine = shard == k
                numbers = (s.part[row[mine]], s.uid[row[mine]], s.doc_id[row[mine]], start[mine])
                doubt.append((k, windows[mine].tobytes(), *(x.astype("<i8").tobytes() for x in numbers)))

        def flush() -> None:
            if texts:
                owner, local, group = equal_windows(texts, width)
                low = np.array(least, np.int64)[owner]
                best = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
                np.minimum.at(best, group, low)
                beaten = low > best[group]
                mask = ~beaten & np.array(hot, bool)[owner]
                if mask.any():
                    leave_in_doubt(owner[mask], local[mask], group[mask])
                # neighbouring lost windows of a stretch are one run before they are dealt to its holders
                owner, local = owner[beaten], local[beaten]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (local[1:] != local[:-1] + 1)
                at = np.flatnonzero(new)
                end = local[np.append(at[1:], len(owner)) - 1] if len(owner) else local
                place, row = held_by(owner[at])
                lost.append((s.part[row], s.uid[row], s.start[row] + local[at][place], s.start[row] + end[place] + width))
            texts.clear(), least.clear(), hot.clear(), holders.clear()

        size = 0
        for i, j in zip(edge, edge[1:], strict=False):
            rows_of: dict[bytes, list[int]] = {}
            for r in range(int(i), int(j)):
                rows_of.setdefault(s.texts[r], []).append(r)
            is_hot = bool(s.total[i] > most)
            for text, rows in rows_of.items():
                if len(rows) > 1:
                    own = np.array(rows)
                    low = s.doc_id[own].min()
                    if (gone := own[s.doc_id[own] > low]).size:
                        lost.append((s.part[gone], s.uid[gone], s.start[gone], s.start[gone] + s.length[gone]))
                    rows = own[s.doc_id[own] == low].tolist()
                if len(rows_of) > 1 or is_hot:
                    texts.append(text)
                    least.append(int(s.doc_id[rows[0]]))
                    hot.append(is_hot)
                    holders.append(rows)
                    size += len(text)
            if size > chunk:
                flush()
                size = 0
        flush()
        gone = _intervals(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*lost, strict=True))) if lost else _intervals(*[np.zeros(0, np.int64)] * 4)
        n, m = gone.num_rows, len(doubt)
        cols = [pa.concat_arrays([gone.column(k), pa.nulls(m, gone.column(k).type)]) for k in range(4)]
        cols += [pa.array([None] * n + [d[0] for d in doubt], pa.int32()), *(pa.array([None] * n + [d[k] for d in doubt], pa.binary()) for k in range(1, 6))]
        return pa.table(cols, ["part", "uid", "first", "last", "shard", "windows", "parts", "uids", "doc_ids", "starts"])

    return run


def merged_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct windows with their smallest documents, of several such runs; two merge by finding one's places in the other."""
    while len(runs) > 1:
        rounds = []
        for (a, x), (b, y) in zip(runs[::2], runs[1::2], strict=False):
            at = np.searchsorted(a, b)
            same = np.zeros(len(b), bool)
            inside = at < len(a)
            same[inside] = a[at[inside]] == b[inside]
            x = x.copy()
            x[at[same]] = np.minimum(x[at[same]], y[same])
            rounds.append((np.insert(a, at[~same], b[~same]), np.insert(x, at[~same], y[~same])))
        runs = rounds + ([runs[-1]] if len(runs) % 2 else [])
    return runs[0]


def _merge_doubt(width: int):
    """Sorted runs of windows in doubt are merged, then each is looked up in the result; only the smallest document keeps a window."""

    def keys(blob: bytes) -> np.ndarray:
        # a byte behind each window, for numpy's strings leave out zeros at the end
        rows = np.frombuffer(blob, np.uint8).reshape(-1, width)
        return np.ascontiguousarray(np.pad(rows, ((0, 0), (0, 1)), constant_values=1)).view(f"S{width + 1}").ravel()

    @_trimmed
    def run(t: pa.Table) -> pa.Table:
        runs = [keys(x) for x in t["windows"].to_pylist()]
        numbers = [[np.frombuffer(x, "<i8") for x in t[c].to_pylist()] for c in ("parts", "uids", "doc_ids", "starts")]
        distinct = []
        for w, doc in zip(runs, numbers[2], strict=True):
            at = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            distinct.append((w[at], np.minimum.reduceat(doc, at)))
        windows, least = merged_runs(distinct)
        beaten = np.concatenate([doc > least[np.searchsorted(windows, w)] for w, doc in zip(runs, numbers[2], strict=True)])
        part, uid, _, start = (np.concatenate(x)[beaten] for x in numbers)
        return pa.Table.from_batches([_intervals(part, uid, start, start + width)])

    return run


def _without(width: int):
    @_trimmed_pair
    def run(texts: pa.Table, gone: pa.Table) -> pa.Table:
        at: dict[int, list[tuple[int, int]]] = {}
        for uid, i, j in zip(gone["uid"].to_pylist(), gone["first"].to_pylist(), gone["last"].to_pylist(), strict=True):
            at.setdefault(uid, []).append((i, j))
        rows = []
        for d, doc, b in _firsts(texts) if texts.num_rows else []:
            kept, removed, spans, upto = hashlib.sha256(), 0, 0, 0
            end = -1
            for i, j in sorted(at.get(_uid(d), ())):
                if i > end:
                    spans += 1
                    kept.update(b[upto:i])
                    end = i
                removed += max(0, j - end)
                end = max(end, j)
                upto = end
            kept.update(b[upto:])
            rows.append((d, doc, len(b), removed, spans, kept.hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["digest", "first", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


#: Bytes of text in a part, which is what a task holds at once; there are PARTS parts per shuffle partition at least.
PART_BYTES, PARTS = 4 << 20, 4
#: At most so many texts are told to all tasks as known to have very many copies.
NAMED = 50_000
#: Identifier that null stands for inside: it comes after all others.
LAST = (1 << 63) - 1


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = 20, chunk: int = 1 << 19, hot: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are taken as UTF-8, null as empty. Bytes go that lie in a string of ``width`` bytes which also starts in a
    document with a smaller identifier; overlaps count, strings are judged on the input. Identifiers are integers; null
    ones come after all others. Rows that repeat an identifier don't remove from each other; all rows are returned.
    Texts shorter than ``width`` lose nothing; an empty table gives no rows; other columns are ignored. ``chunk`` bounds
    the bytes of one suffix array; anchors of more than ``hot`` documents are dealt to several shards.
    """
    spark = docs.sparkSession
    n = parts(spark)
    source = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("b"))
    b = F.coalesce("b", F.lit(b""))
    rows = durable(source.select("doc_id", F.unhex(F.sha2(b, 256)).alias("digest"), F.octet_length(b).alias("size")))
    many, size = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # of all rows at most NAMED groups are larger than this
    often = max(64, -(-many // NAMED))
    groups = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where(F.col("copies") > often)
    known = {bytes(r["digest"]): r["first"] for r in groups.collect()}
    cuts = max(PARTS * n, -(-size // PART_BYTES))
    shards = max(n, cuts // PARTS)
    with stored(source.mapInArrow(_local_firsts(cuts, known), RAW).repartition(n, "part"), n, "part") as texts:
        runs = texts.groupBy("part").applyInArrow(_anchor_runs(width, gram, shards), RUN)
        shared = runs.groupBy("slice").applyInArrow(_shared_anchors, RUN)
        cut = texts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_cut_stretches(width, gram, shards, hot), STRETCH)
        judged = durable(cut.groupBy("shard").applyInArrow(_judge_shard(width, chunk, hot, shards), JUDGED))
        merged = judged.where("shard is not null").groupBy("shard").applyInArrow(_merge_doubt(width), GONE)
        gone = judged.where("shard is null").select("part", "uid", "first", "last").unionByName(merged)
        done = durable(texts.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(_without(width), DONE))
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= width)
    return rows.join(done, "digest").select(
        F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )

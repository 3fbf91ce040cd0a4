"""Packing token streams into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows, which need no partner, and a remainder in pieces of at most ``grain`` ids.
Pieces are gathered into blocks that fill a number of windows almost to the brim; the last few ids of a block are cut
into small pieces, with which differencing can level its windows. Within a block every piece starts as a partial
partition with one filled window; the two partial partitions with the largest imbalance merge, the fullest windows of
one on the emptiest of the other, until one partition is left, whose windows are then nearly equal. If one of them
exceeds the capacity, the block gets one window more and is partitioned again.

Everything happens inside the input's partitions: no shuffle, no collecting, one block in memory at a time.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` in ``k`` sets of nearly equal sums. Ties go to the lower index."""
    if k == 1:
        return [list(range(len(sizes)))]
    # a partial partition: ascending sums, and for each window the node of a forest whose leaves are pieces
    forest: list[tuple[int, int]] = []
    n = len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        sums, top = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[-1], top[-1] = s, i
        heap.append((-s, i, sums, top))
    heapq.heapify(heap)
    number = n
    while len(heap) > 1:
        _, _, s1, t1 = heapq.heappop(heap)
        _, _, s2, t2 = heapq.heappop(heap)
        # the fullest windows of one meet the emptiest of the other
        t2 = t2[::-1]
        sums, top = s1 + s2[::-1], np.maximum(t1, t2)
        for w in np.flatnonzero((t1 >= 0) & (t2 >= 0)).tolist():
            top[w] = n + len(forest)
            forest.append((int(t1[w]), int(t2[w])))
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums -= sums[0]
        heapq.heappush(heap, (-int(sums[-1]), number, sums, top[order]))
        number += 1
    out = []
    for t in heap[0][3].tolist() if heap else []:
        members, todo = [], [t] if t >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                members.append(x)
            else:
                todo.extend(forest[x - n])
        if members:
            out.append(members)
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sets of indices whose sums fit ``capacity``; the number of windows starts at the least possible and rises."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = differencing(sizes, k)
        if all(sum(sizes[i] for i in x) <= capacity for x in sets):
            return sets
        k += 1


#: Sizes in turn of the pieces that the end of a block is cut into.
LADDER = (32, 16, 8, 4, 2, 1)


class Encoder:
    """Token ids of whole texts. Between two characters that aren't white space a single space always begins a new
    pre-token, so the stretches between such spaces are encoded once each and looked up afterwards."""

    def __init__(self, vocabulary: str, held: int = 1_000_000):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.fast = self._ranked(vocabulary)
        self.memo = _Memo(self._ids, held)
        self.space = re.compile(r"(?<=\S) (?=\S)")

    def _ranked(self, vocabulary: str) -> Callable[[str], list[int]] | None:
        """The same vocabulary as ranks, if its merges are in rank order and nothing else alters the text: encodes several times faster."""
        import json

        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            j = json.load(f)
        pre = j.get("pre_tokenizer") or {}
        if j.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or j["model"].get("ignore_merges"):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"] for t in j["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in j["model"]["vocab"].items() if token not in special}
        merged = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        ids = [j["model"]["vocab"][a + b] for a, b in merged]
        if ids != sorted(ids):
            return None
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        inner = tiktoken.Encoding("held", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda x: self.exact.encode(x, add_special_tokens=False).ids if any(s in x for s in special) else inner.encode_ordinary(x)

    def _ids(self, chunk: str) -> bytes:
        return array("I", self.fast(chunk) if self.fast else self.exact.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        first, *rest = text.split(" ")
        try:
            return self._ids(first) + b"".join(map(self.memo.__getitem__, rest)) if text else b""
        except _BlankEdge:
            # borders only between two characters that aren't blank; just the first and last stretch may have blank ends
            first, *rest = self.space.split(text)
            last = self._ids(" " + rest.pop()) if rest else b""
            return self._ids(first) + b"".join(map(self.memo.__getitem__, rest)) + last


class _BlankEdge(Exception):
    """A stretch begins or ends with white space, so the space before or after it isn't a border."""


class _Memo(dict):
    """Stretch -> ids of it with the space before it."""

    def __init__(self, ids: Callable[[str], bytes], held: int):
        super().__init__()
        self.ids, self.held = ids, held

    def __missing__(self, w: str) -> bytes:
        if not w or w[0].isspace() or w[-1].isspace():
            raise _BlankEdge
        out = self.ids(" " + w)
        if len(w) <= 40:
            if len(self) >= self.held:
                self.clear()
            self[w] = out
        return out


_ENCODERS: dict[str, Encoder] = {}


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, grain: int = 512, windows: int = 64, margin: int = 2, fine: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A row's ids are those of its text (null is the empty text), then ``end_id``; each id lies in exactly one piece.
    Windows hold ``capacity`` ids at most. Blocks aim at ``windows`` windows less ``margin`` ids each, ``fine`` ids a
    window being cut small; the last block of a partition is smaller. Repeated rows are packed each on their own,
    identifiers keep their type and null ones stay null, an empty table gives no rows, other columns are ignored.
    sequence_id is the partition's number times 2^40 plus a running number.
    """
    thin = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, Encoder(vocabulary))
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        end = end_id.to_bytes(4, "little")
        rows: list[tuple] = []
        block: list[tuple] = []
        filled, room = 0, windows * (capacity - margin)
        coarse = room - windows * fine

        def flush() -> None:
            nonlocal sequence, filled
            for window in pack([len(p[2]) // 4 for p in block], capacity):
                offset = 0
                for i in sorted(window):
                    doc, start, ids, n = block[i]
                    rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, sequence, offset))
                    offset += len(ids) // 4
                sequence += 1
            block.clear()
            filled = 0

        def out(kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else kind) for k, c in enumerate(cols)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                at = n // capacity * capacity
                for start in range(0, at, capacity):
                    rows.append((doc, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), n, sequence, 0))
                    sequence += 1
                while at < n:
                    length = min(n - at, grain, coarse - filled) if filled < coarse else min(n - at, LADDER[len(block) % len(LADDER)], room - filled)
                    block.append((doc, at, ids[4 * at : 4 * (at + length)], n))
                    filled += length
                    at += length
                    if filled == room:
                        flush()
                if len(rows) > 20_000:
                    yield out(kind)
        if block:
            flush()
        if rows:
            yield out(kind)

    return thin.mapInArrow(run, f"doc_id {thin.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")

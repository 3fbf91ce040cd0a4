"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays.

Trees are grown on histograms with logistic loss. On features with a monotone constraint a split must order its
children's values, and every child inherits the bound between them, so the score never rises with, say, the share of
symbols. The trees are then flattened into arrays of feature, threshold, child and value, and whole batches descend
them level by level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, smallest_hashes

SYMBOLS = re.compile(rb"[#*$%&|<>]")
SPACES = bytes([0x20, *range(0x09, 0x0E)])

#: Features of the trees and their constraints: +1 the score may only rise with it, -1 only fall, 0 free.
FEATURES = {
    "log_words": 1, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "distinct_share": 0, "words_per_line": 0, "pipe_share": -1, "bang_share": -1,
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The contract's counts and the trees' features of one whole text; null counts as the empty text."""
    b = text.encode("utf-8", "surrogatepass") if text else b""
    words = b.split()
    n = len(words)
    chars = sum(x & 0xC0 != 0x80 for w in words for x in w) if n < 4 else _points(b)
    symbols = len(SYMBOLS.findall(b))
    lines = [line for line in b.split(b"\n") if line.split(None, 1)]
    dup_lines = len(lines) - len(set(lines))
    repeated = _repeated(words)
    distinct = len(set(words))
    letters = np.frombuffer(b, np.uint8)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    digits = int(((letters >= 48) & (letters <= 57)).sum())
    per, per_char = max(n, 1), max(chars, 1)
    features = [
        np.log1p(n), chars / per, symbols / per_char, dup_lines / max(len(lines), 1), repeated / per,
        upper / per_char, digits / per_char, distinct / per, n / max(len(lines), 1), b.count(b"|") / per, b.count(b"!") / per,
    ]
    return [n, chars, symbols, dup_lines, repeated], features


def _points(b: bytes) -> int:
    """Code points outside white space: bytes that are neither continuation bytes nor white space."""
    return len(b.translate(None, SPACES + bytes(range(0x80, 0xC0))))


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    if v < 2_000_000:
        _, codes = np.unique((ids[:-2] * v + ids[1:-1]) * v + ids[2:], return_inverse=True)
        again = np.bincount(codes)[codes] > 1
    else:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(windows)
        again = np.fromiter((seen[w] > 1 for w in windows), bool, n - 2)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the five counts and ``x``, the array of features, per row."""
    thin = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t.as_py()) for t in b.column(1)]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(STATS))
            flat = np.array([x for _, x in found], np.float64).reshape(-1, len(FEATURES))
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(FEATURES), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, k]) for k in range(len(STATS))), x], ["doc_id", *STATS, "x"])

    return thin.mapInArrow(run, f"{_id_of(thin)}, " + ", ".join(f"{s} long" for s in STATS) + ", x array<double>")


def _id_of(rows: DataFrame) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"


@dataclass
class Trees:
    """Flat nodes of all trees: a leaf has feature -1. ``roots`` holds each tree's first node."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                leaf = f < 0
                step = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(leaf, at, step)
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


@dataclass
class _Grower:
    x: np.ndarray
    codes: np.ndarray
    edges: list[np.ndarray]
    signs: np.ndarray
    max_depth: int
    least: int
    l2: float
    rate: float
    nodes: list[list[float]] = field(default_factory=list)

    def grow(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Adds one tree; gives its value per row."""
        out = np.zeros(len(g))
        self._node(np.arange(len(g)), g, h, 0, -np.inf, np.inf, out)
        return out

    def _node(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float, out: np.ndarray) -> int:
        me = len(self.nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + self.l2), low, high))
        self.nodes.append([-1, 0.0, -1, -1, value * self.rate])
        split = self._split(rows, g, h, low, high) if depth < self.max_depth and len(rows) >= 2 * self.least else None
        if split is None:
            out[rows] = value * self.rate
            return me
        f, b, vl, vr = split
        goes = self.codes[rows, f] <= b
        middle = (vl + vr) / 2
        lo_l, hi_l, lo_r, hi_r = low, high, low, high
        if self.signs[f] > 0:
            hi_l, lo_r = min(high, middle), max(low, middle)
        elif self.signs[f] < 0:
            lo_l, hi_r = max(low, middle), min(high, middle)
        left = self._node(rows[goes], g, h, depth + 1, lo_l, hi_l, out)
        right = self._node(rows[~goes], g, h, depth + 1, lo_r, hi_r, out)
        self.nodes[me] = [f, float(self.edges[f][b]), left, right, 0.0]
        return me

    def _split(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float) -> tuple[int, int, float, float] | None:
        gs, hs, best, found = g[rows].sum(), h[rows].sum(), 1e-6, None
        whole = gs * gs / (hs + self.l2)
        for f, edges in enumerate(self.edges):
            if not len(edges):
                continue
            c, k = self.codes[rows, f], len(edges) + 1
            gl, hl, nl = (np.cumsum(np.bincount(c, w, k))[:-1] for w in (g[rows], h[rows], None))
            vl = np.clip(-gl / (hl + self.l2), low, high)
            vr = np.clip(-(gs - gl) / (hs - hl + self.l2), low, high)
            gain = -(2 * gl * vl + (hl + self.l2) * vl**2) - (2 * (gs - gl) * vr + (hs - hl + self.l2) * vr**2) - whole
            ok = (nl >= self.least) & (len(rows) - nl >= self.least) & (self.signs[f] * (vr - vl) >= 0)
            gain = np.where(ok, gain, -np.inf)
            b = int(np.argmax(gain))
            if gain[b] > best:
                best, found = float(gain[b]), (f, b, float(vl[b]), float(vr[b]))
        return found


def train(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 5, l2: float = 1.0) -> Trees:
    """Boosted trees for P(y = 1). One class only, or no rows, gives the base rate."""
    n = len(y)
    p = min(max((y.sum() + 1) / (n + 2), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] if n else e for f, e in enumerate(edges)]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if n else np.zeros((0, x.shape[1]), int)
    grower = _Grower(x, codes, edges, np.array(signs), depth, least, l2, rate)
    margin, roots = np.full(n, base), []
    for _ in range(trees if 0 < y.sum() < n else 0):
        q = 1 / (1 + np.exp(-margin))
        roots.append(len(grower.nodes))
        margin += grower.grow(q - y, q * (1 - q))
    flat = np.array(grower.nodes).reshape(-1, 5)
    return Trees(base, np.array(roots, int), flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], depth)


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    base_failed: under 50 words, or over half of the words in repeated three-word windows. kept: not base_failed and the
    trees' score is at least ``threshold``. The trees are fitted on at most ``sample`` labelled rows, those with about the
    smallest hashes of doc_id; without labels every score is one half and ``threshold`` decides alike for all. Null and
    empty texts have counts of zero; labels that are null are ignored, of repeated labels the smallest counts; repeated
    rows are all returned; an empty table gives no rows; other columns are ignored.
    """
    rows = durable(measure(docs, id_col, text_col))
    y = F.min(labels[label_col]).cast("int").alias("y")
    marks = durable(labels.where(labels[label_col].isNotNull() & labels[label_id_col].isNotNull()).groupBy(labels[label_id_col].alias("marked")).agg(y).withColumn("h", F.xxhash64("marked")))
    # little more than ``sample`` identifiers
    chosen = F.broadcast(smallest_hashes(marks, "h", {None: max(1, marks.count())}, sample))
    fit = rows.join(chosen, F.col("doc_id") == F.col("marked")).select("h", "x", "y").toPandas().sort_values("h", kind="stable").head(sample)
    x = np.array(fit["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    model = train(x, fit["y"].to_numpy(np.float64), list(FEATURES.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.asarray(b.column("x").flatten()).reshape(-1, len(FEATURES))
            cols = [b.column(c) for c in ["doc_id", *STATS]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(model.score(flat))], ["doc_id", *STATS, "score"])

    scored = rows.mapInArrow(run, f"{_id_of(rows)}, " + ", ".join(f"{s} long" for s in STATS) + ", score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select("doc_id", *STATS, failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")

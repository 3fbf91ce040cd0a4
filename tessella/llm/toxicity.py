"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is learned from labelled rows: words and word stems that documents marked toxic have and others hardly do.
Its trie is intersected with the automaton that allows one edit; the product is made deterministic lazily, state by
state, so that reading a word costs a table look-up per letter and most words die after a few. Each hit is then judged
by its context window: paired quotation marks around it, words of reported speech, address of the reader. How much such
a window speaks for abuse is learned from the labels as well, and so is the logistic regression that turns a text's sums
into a score.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import crc32_text, durable

WORD = re.compile(r"[^\W_]+")
#: Paired quotation marks and what stands between them; a pair doesn't cross a line.
QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|»[^«\n]*«|‹[^›\n]*›')
#: Fixed word lists: signs of reported speech, and of address to the reader.
REPORTING = frozenset("said says wrote writes quoted quote quotes called term word phrase reported allegedly sagte schrieb zitat wort dijo escribió palabra dit écrit mot".split())
ADDRESS = frozenset("you your youre u ur yourself du dich dein deine ihr tú tu tus eres vous toi ton".split())
WINDOW = 8
#: Stems have this many letters; words need as many for an edit to be allowed.
STEMS, EDITABLE = (3, 7), 5
#: Words that a worker remembers, at most so long, and states that an automaton keeps; beyond that they are forgotten and found anew.
HELD, LONGEST, STATES = 400_000, 40, 200_000
EXACT, STEM, EDITED = 1, 2, 3
#: Bits of a hit's context window, and how many kinds of hits in windows there are.
IN_QUOTES, REPORTED, ADDRESSED = 1, 2, 4
KINDS = 3 * 8


class LexiconAutomaton:
    """Lexicon trie x Levenshtein automaton, determinised as words are read.

    ``words`` maps a word to the number of edits allowed (0 or 1); ``stems`` match every word that begins with them.
    """

    def __init__(self, words: dict[str, int], stems: set[str]):
        self.child: list[dict[str, int]] = [{}]
        self.edits: list[int] = [-1]
        self.stem: list[bool] = [False]
        #: the most edits that any word below a node allows
        self.best: list[int] = [-1]
        for w, e in words.items():
            for node in self._add(w):
                self.best[node] = max(self.best[node], e)
            self.edits[node] = max(self.edits[node], e)
        for s in stems:
            for node in self._add(s):
                self.best[node] = max(self.best[node], 0)
            self.stem[node] = True
        self._begin()

    def _begin(self) -> None:
        start = frozenset(self._closed({(0, 0)})) if len(self.child) > 1 else frozenset()
        self.states = {start: 0}
        self.sets = [start]
        self.moves: list[dict[str, int]] = [{}]
        self.verdict = [self._verdict(start)]

    def _add(self, word: str) -> Iterator[int]:
        node = 0
        yield node
        for c in word:
            nxt = self.child[node].get(c)
            if nxt is None:
                nxt = len(self.child)
                self.child.append({})
                self.edits.append(-1)
                self.stem.append(False)
                self.best.append(-1)
                self.child[node][c] = nxt
            node = nxt
            yield node

    def _closed(self, items: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """With letters of the lexicon's word that the text's word lacks, and without what no word below allows."""
        more = {(n, e + 1) for m, e in items if e == 0 for n in self.child[m].values()}
        return {(n, e) for n, e in items | more if self.best[n] >= e}

    def _step(self, items: frozenset, c: str) -> frozenset:
        out = set()
        for n, e in items:
            for d, m in self.child[n].items():
                if d == c:
                    out.add((m, e))
                elif e == 0:
                    out.add((m, 1))
            if e == 0:
                out.add((n, 1))
        return frozenset(self._closed(out))

    def _verdict(self, items: frozenset) -> int:
        """What ends here: an exact word, an edited one, nothing."""
        ends = [e for n, e in items if self.edits[n] >= e]
        return 0 if not ends else EXACT if min(ends) == 0 else EDITED

    def match(self, word: str) -> int:
        """EXACT, STEM or EDITED, in this order of preference, or 0."""
        if len(self.sets) > STATES:
            self._begin()
        at, stem = 0, False
        for c in word:
            moves = self.moves[at]
            to = moves.get(c)
            if to is None:
                items = self._step(self.sets[at], c)
                to = self.states.get(items)
                if to is None:
                    to = self.states[items] = len(self.sets)
                    self.sets.append(items)
                    self.moves.append({})
                    self.verdict.append(self._verdict(items))
                moves[c] = to
            at = to
            items = self.sets[at]
            if not items:
                return STEM if stem else 0
            if not stem:
                stem = any(self.stem[n] for n, e in items if e == 0)
        v = self.verdict[at]
        return v if v == EXACT else STEM if stem else v


class _Matches(dict):
    def __init__(self, automaton: LexiconAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        out = self.automaton.match(word)
        if len(word) <= LONGEST:
            if len(self) >= HELD:
                self.clear()
            self[word] = out
        return out


FEATURES = ["abuse", "abuse_share", "exact", "stem", "edited", "quoted"]


def hits(text: str | None, matches: _Matches) -> tuple[np.ndarray, int]:
    """How many hits of each kind a whole text has in each sort of context window, and the number of its words."""
    counts = np.zeros(KINDS)
    low = text.lower() if text else ""
    words = WORD.findall(low)
    if not any([matches[w] for w in words]):
        return counts, len(words)
    spans = list(WORD.finditer(low))
    quoted = [m.span() for m in QUOTED.finditer(low)]
    begins = [a for a, _ in quoted]
    for i, m in enumerate(spans):
        kind = matches[m[0]]
        if not kind:
            continue
        near = {x[0] for x in spans[max(0, i - WINDOW) : i + WINDOW + 1]}
        q = bisect(begins, m.start()) - 1
        sort = IN_QUOTES * (q >= 0 and m.end() <= quoted[q][1]) + REPORTED * bool(near & REPORTING) + ADDRESSED * bool(near & ADDRESS)
        counts[8 * (kind - 1) + sort] += 1
    return counts, len(words)


def window_weights(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each kind of hit and sort of window the chance that such a hit is abuse, by labelled texts' ``counts``.

    A logistic regression on the window's signs and the kind, over the sums of both classes: sorts of windows that are
    rare follow from their signs.
    """
    kind, sort = np.divmod(np.arange(KINDS), 8)
    signs = np.column_stack([(sort & bit) > 0 for bit in (IN_QUOTES, REPORTED, ADDRESSED)] + [kind == STEM - 1, kind == EDITED - 1]).astype(float)
    toxic, clean = counts[y == 1].sum(axis=0), counts[y == 0].sum(axis=0)
    w = _logistic(np.vstack([signs, signs]), np.repeat([1.0, 0.0], KINDS), l2=1.0, weight=np.concatenate([toxic, clean]))
    return _probability(signs, w)


def features(counts: np.ndarray, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each row of ``counts``."""
    abuse = counts @ weights
    kinds = counts.reshape(-1, 3, 8).sum(axis=2)
    return np.log1p(np.column_stack([abuse, 100 * abuse / np.maximum(words, 1), kinds, counts.sum(axis=1) - abuse]))


#: Bits that tell apart the words before a term, over four columns.
BITS = 256
PARTS = [f"after{k}" for k in range(BITS // 64)]


def _learn_lexicon(sample: DataFrame, n_toxic: int, fewest: int, least: float, purity: float, variety: float) -> tuple[dict[str, int], set[str]]:
    """Words and shortest stems that many toxic documents of ``sample(text, y)`` have and hardly any other.

    Rare words that only copies of one toxic document share would pass as well; they follow the same word wherever they
    stand. A term must therefore follow at least ``variety`` of the different words that its document count allows for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        after: Counter = Counter()
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = WORD.findall((t.as_py() or "").lower())
                terms: dict[str, int] = {}
                for before, w in zip(["", *words], words, strict=False):
                    if w not in terms:
                        bit = 1 << zlib.crc32(before.encode("utf-8", "surrogatepass")) % BITS
                        if len(w) >= 3:
                            terms[w] = bit
                        for n in range(STEMS[0], min(STEMS[1], len(w)) + 1):
                            terms.setdefault(f"{w[:n]}*", bit)
                counts[y].update(terms.keys())
                if y:
                    for term, bit in terms.items():
                        after[term] |= bit
        terms = list(counts[0].keys() | counts[1].keys())
        parts = [pa.array([(after[t] >> (64 * k)) & (2**64 - 1) for t in terms], pa.uint64()).view(pa.int64()) for k in range(BITS // 64)]
        numbers = [pa.array([c[t] for t in terms], pa.int64()) for c in counts]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *numbers, *parts], ["term", "clean", "toxic", *PARTS])

    counted = sample.mapInArrow(run, "term string, clean long, toxic long, " + ", ".join(f"{x} long" for x in PARTS))
    counted = counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), *[F.bit_or(x).alias(x) for x in PARTS])
    varied = sum((F.bit_count(x) for x in PARTS), F.lit(0))
    possible = BITS * (1 - F.pow(F.lit(1 - 1 / BITS), F.col("toxic")))
    need = max(float(fewest), least * n_toxic)
    good = counted.where((F.col("toxic") >= need) & (F.col("clean") <= purity * F.col("toxic")) & (varied >= variety * possible))
    # the sample bounds how many terms there are
    rows = good.collect()
    stems: set[str] = set()
    for s in sorted((r["term"][:-1] for r in rows if r["term"].endswith("*")), key=lambda x: (len(x), x)):
        if not any(s[:n] in stems for n in range(STEMS[0], len(s))):
            stems.add(s)
    words = {r["term"]: int(len(r["term"]) >= EDITABLE) for r in rows if not r["term"].endswith("*")}
    return words, stems


def _hits_of(sample: DataFrame, automaton: LexiconAutomaton) -> pd.DataFrame:
    """y, counts of hits and number of words per sampled row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(automaton)
        for b in batches:
            found = [hits(t.as_py(), matches) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([c for c, _ in found], pa.list_(pa.float64())), pa.array([n for _, n in found], pa.int64())], ["y", "counts", "words"])

    return sample.mapInArrow(run, "y int, counts array<double>, words long").toPandas()


def _edited_of(sample: DataFrame, automaton: LexiconAutomaton) -> pd.DataFrame:
    """How many texts of each class, y, have each word that only an edit matched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(automaton)
        for b in batches:
            found = [[w for w in set(WORD.findall((t.as_py() or "").lower())) if matches[w] == EDITED] for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.string()))], ["y", "words"])

    return sample.mapInArrow(run, "y int, words array<string>").select("y", F.explode("words").alias("word")).groupBy("y", "word").count().toPandas()


def _without_common_edits(words: dict[str, int], edited: pd.DataFrame) -> dict[str, int]:
    """Takes the edit from words whose neighbours turn up in clean documents more than in one toxic of twenty."""
    seen: dict[str, list[int]] = {}
    for y, w, n in edited[["y", "word", "count"]].itertuples(index=False):
        seen.setdefault(w, [0, 0])[y] += n
    bad = {w for w, (clean, toxic) in seen.items() if clean > 0.05 * toxic}
    return {w: 0 if e and any(_one_edit(w, b) for b in bad) else e for w, e in words.items()}


def _one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton's method, intercept last and unpenalised."""
    x1 = np.column_stack([x, np.ones(len(x))])
    many = np.ones(len(x)) if weight is None else weight
    w, ridge = np.zeros(x1.shape[1]), np.diag([l2] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = _probability(x, w)
        step = np.linalg.solve((x1 * (many * p * (1 - p) + 1e-9)[:, None]).T @ x1 + ridge, x1.T @ (many * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    automaton: LexiconAutomaton
    #: of hits by kind and window
    windows: np.ndarray
    #: of FEATURES, then the intercept
    weights: np.ndarray

    def score(self, texts: Iterable[str | None], matches: _Matches) -> np.ndarray:
        found = [hits(t, matches) for t in texts]
        counts = np.array([c for c, _ in found]).reshape(-1, KINDS)
        return _probability(features(counts, np.array([n for _, n in found]), self.windows), self.weights)


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 3000, most_clean: int = 6000, fewest: int = 6, least: float = 0.004, purity: float = 0.02, variety: float = 0.4, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic") -> Model | None:
    """Lexicon and weights from labelled rows whose crc32(doc_id) mod 5 isn't 0; None without both classes.

    The sample's documented bound: ``most_toxic`` and ``most_clean`` rows, those with the smallest hash of doc_id. A term
    of the lexicon stands in ``fewest`` sampled toxic documents at least, and in a share of ``least``.
    """
    marks = labels.where(labels[label_col].isNotNull() & labels[label_id_col].isNotNull() & (crc32_text(labels[label_id_col]) % 5 != 0))
    marks = marks.groupBy(labels[label_id_col].alias("doc_id")).agg(F.max(labels[label_col].cast("int")).alias("y"))
    marks = marks.withColumn("h", F.xxhash64("doc_id", F.lit(5)))
    picked = [marks.where(F.col("y") == y).orderBy("h", "doc_id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    ids = picked[0].unionByName(picked[1]).select("doc_id", "y")
    # at most most_toxic + most_clean identifiers
    sample = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(ids), "doc_id").select("text", "y")
    have = dict(ids.groupBy("y").count().collect())
    if not have.get(1) or not have.get(0):
        return None
    sample = durable(sample.repartition(min(64, 2 + (have[0] + have[1]) // 256)))
    words, stems = _learn_lexicon(sample, have[1], fewest, least, purity, variety)
    words = _without_common_edits(words, _edited_of(sample, LexiconAutomaton(words, stems)))
    automaton = LexiconAutomaton(words, stems)
    found = _hits_of(sample, automaton)
    counts, y = np.array(found["counts"].tolist()).reshape(-1, KINDS), found["y"].to_numpy(np.float64)
    windows = window_weights(counts, y)
    return Model(automaton, windows, _logistic(features(counts, found["words"].to_numpy(), windows), y))


def scorer(model: Model | None):
    """A vectorised function of the text: the probability of abuse."""
    state: dict[str, _Matches] = {}

    def score(text: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.zeros(len(text)))
        return pd.Series(model.score(text, state.setdefault("matches", _Matches(model.automaton))))

    return F.pandas_udf(score, DoubleType())


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: float) -> DataFrame:
    """Every row: doc_id, held_out, score, predicted.

    Null and empty texts score like texts without a hit; if labels lack one class all scores are 0. Labels that are
    null are ignored, of repeated labels the largest counts. A score of exactly one half predicts 1. Repeated rows are all
    returned; an empty table gives no rows; other columns are ignored.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, **bounds)
    out = docs.select(docs[id_col].alias("doc_id"), (crc32_text(docs[id_col]) % 5 == 0).alias("held_out"), scorer(model)(docs[text_col]).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

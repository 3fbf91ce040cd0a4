"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased text gives hashed character n-grams; a text's features are its n-gram shares times their inverse document
frequency. Weights come from follow-the-regularised-leader with an elastic net (per-coordinate rates, L1 truncation to
exact zeros, L2 shrinkage), a temperature is then fitted on rows kept back. Hashing and counting run in numpy over a
whole text at a time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import crc32_text, durable, smallest_hashes

SIZES, SLOTS, SCALE = (1, 2, 3), 1 << 15, 50.0
#: Odd multipliers of the n-gram hash, one for each place in an n-gram.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


#: By code point: letters, and letters or marks. Those above the table count as letters in n-grams.
LETTERS = np.array([chr(c).isalpha() for c in range(1 << 16)])
SPELT = LETTERS | np.array([unicodedata.category(chr(c))[0] == "M" for c in range(1 << 16)])
SPELT[-1] = True
BLANK = np.uint64(32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def has_letter(text: str) -> bool:
    points = code_points(text)
    return bool(LETTERS[points[points < 1 << 16]].any()) or any(chr(c).isalpha() for c in np.unique(points[points >= 1 << 16]).tolist())


def text_counts(text: str | None) -> np.ndarray:
    """How often each slot's character n-grams occur in a whole text, lower-cased; whatever isn't a letter is one blank."""
    points = code_points(text.lower()) if text else np.zeros(0, np.uint32)
    spelt = SPELT[np.minimum(points, (1 << 16) - 1)]
    if not spelt.any():
        return np.zeros(SLOTS, np.int64)
    keep = spelt.copy()
    keep[1:] |= spelt[:-1]
    inner = np.where(spelt, points, 32)[keep].astype(np.uint64)
    points = np.concatenate([[BLANK], inner, [BLANK]] if spelt[-1] else [[BLANK], inner])
    terms = [points * m for m in MIX]
    slots = []
    for n in SIZES:
        h = terms[0][: len(points) - n + 1].copy()
        for k in range(1, n):
            h += terms[k][k : len(points) - n + 1 + k]
        h ^= h >> np.uint64(29)
        h *= MIX[n - 1]
        slots.append((h >> np.uint64(64 - 15)).astype(np.int64))
    return np.bincount(np.concatenate(slots), minlength=SLOTS)


def text_vector(text: str | None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text and their shares; of all of them, or of the ``most`` frequent."""
    counts = text_counts(text)
    at = np.flatnonzero(counts)
    if most is not None and len(at) > most:
        at = np.sort(at[np.argsort(-counts[at], kind="stable")[:most]])
    return at, counts[at] / max(counts.sum(), 1)


def document_frequency(texts: DataFrame) -> np.ndarray:
    """In how many of all ``texts(text)`` each slot occurs, then their number: partitions add up dense counts of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(SLOTS + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                df[:-1] += text_counts(t.as_py()) > 0
                df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["slot", "n"])

    total = np.zeros(SLOTS + 1, np.int64)
    for slot, n in texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n")).toPandas().itertuples(index=False):
        total[slot] = n
    return total


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, slots: np.ndarray, shares: np.ndarray) -> np.ndarray:
        return (shares * self.idf[slots]) @ self.weights[slots] * SCALE + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], df: np.ndarray, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, back: int = 5) -> Model:
    """FTRL-proximal on all but every ``back``-th row, then the temperature that those rows like best."""
    k = len(langs)
    idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0
    z, n = np.zeros((SLOTS + 1, k)), np.zeros((SLOTS + 1, k))

    def weights(at) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    learn = [i for i in range(len(y)) if i % back or len(y) < 2 * back]
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(learn):
            slots, shares = vectors[i]
            at, x = np.append(slots, SLOTS), np.append(shares * idf[slots] * SCALE, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y[i]] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    all_w = weights(slice(None))
    model = Model(langs, idf, all_w[:-1], all_w[-1], 1.0)
    test = [i for i in range(len(y)) if i % back == 0] or learn
    if test:
        out = np.array([model.logits(*vectors[i]) for i in test])
        grid = np.geomspace(0.05, 20, 121)
        loss = [-np.log(np.maximum(softmax(out / t)[np.arange(len(test)), y[test]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, per_lang: int = 400, sample: int = 8000, most_slots: int = 4096, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learns from rows with a language whose crc32(doc_id) mod 3 isn't 1; None if there are none.

    Document frequencies cover all of those rows. Weights are fitted on at most ``per_lang`` of them for each language,
    fewer where there are more than ``sample`` / ``per_lang`` languages (but one at least), those with the smallest hash
    of doc_id, and on the ``most_slots`` most frequent n-grams of each: the documented bounds of the sample.
    """
    known = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & (crc32_text(F.col("doc_id")) % 3 != 1))
    ids = durable(known.where("doc_id is not null").groupBy("lang", "doc_id").count().select("lang", "doc_id", F.xxhash64("doc_id", F.lit(3)).alias("h")))
    sizes = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    each = max(1, min(per_lang, sample // len(sizes)))
    chosen = smallest_hashes(ids, "h", sizes, each, "lang").select("doc_id").distinct()
    # little more than ``each`` identifiers a language
    rows = known.join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [text_vector(t.as_py(), most_slots) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("lang"), pa.array([s.astype("<u2").tobytes() for s, _ in got], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())],
                ["h", "lang", "slots", "shares"],
            )

    vectors = rows.select(F.xxhash64("doc_id", F.lit(3)).alias("h"), "lang", "text").mapInArrow(run, "h long, lang string, slots binary, shares binary").toPandas()
    vectors = vectors.sort_values(["h", "lang", "slots"], kind="stable").groupby("lang").head(each).reset_index(drop=True)
    langs = sorted(vectors["lang"].unique())
    x = [(np.frombuffer(s, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64)) for s, v in zip(vectors["slots"], vectors["shares"], strict=True)]
    return fit(x, vectors["lang"].map({l: i for i, l in enumerate(langs)}).to_numpy(), langs, document_frequency(known.select("text")))


def predictor(model: Model | None):
    """A vectorised function of the text: struct(lang_pred, score)."""
    schema = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def predict(text: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for t in text:
            if t is None or model is None or not has_letter(t):
                langs.append("und")
                scores.append(0.0)
                continue
            p = softmax(model.logits(*text_vector(t)) / model.temperature)
            best = int(p.argmax())
            langs.append(model.langs[best])
            scores.append(float(p[best]))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return F.pandas_udf(predict, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    """Every row: doc_id, held_out, lang_pred, score (the calibrated probability of lang_pred).

    Null texts and texts without a letter are ``und`` with score 0, and so is all if no row has a language to learn
    from. Of languages that tie the first by code point is taken. Labels in ``lang`` of rows held out (crc32(doc_id)
    mod 3 is 1) aren't read. Repeated rows are all returned; an empty table gives no rows; other columns are ignored.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    out = docs.select(docs[id_col].alias("doc_id"), (crc32_text(docs[id_col]) % 3 == 1).alias("held_out"), predictor(model)(docs[text_col]).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def accepted(docs: DataFrame, least: float = 0.5, text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of ``docs`` with a known language of probability ``least`` or more, with their columns as they were."""
    model = train(docs, text_col=text_col, **columns)
    wide = docs.select(F.struct("*").alias("row"), predictor(model)(docs[text_col]).alias("p"))
    return wide.where((F.col("p.lang_pred") != "und") & (F.col("p.score") >= least)).select("row.*")

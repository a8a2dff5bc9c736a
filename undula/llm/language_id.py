r"""Operator 5, language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Letters of a text, lower-cased, other characters as one space, give n-grams of 1 to 3 characters, hashed to FEATURES columns;
a value is log(1 + count) times the column's inverse document frequency, rows have length 1. The regression is trained
with follow-the-regularised-leader (per-coordinate rates, elastic net: L1 makes columns exactly zero, L2 shrinks), then a
temperature is fitted by a line search on a fifth of the training rows that the weights did not see.

Training rows: text and lang not null, crc32(doc_id as text) mod 5 not 0; at most SAMPLE of them, an equal number of each
language, those with the least hashes of doc_id, whose texts have at most SAMPLE_CHARS characters; so the driver's work
is bounded and a rare language keeps its share however large the corpus. Prediction reads
every whole text. A null text or one without a letter is `und` with score 0; without training rows all are.
Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.common import arrow_map, batch, class_sample, remainder, table

FEATURES, SAMPLE, SAMPLE_CHARS = 1 << 14, 4000, 10_000
ALPHA, BETA, L1, L2, EPOCHS, ROWS = 0.5, 1.0, 0.002, 0.01, 4, 32
LETTER, OTHER = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")
PART = 1 << 20


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text, in parts of PART characters that overlap so that no n-gram is lost."""
    c = np.frombuffer((" " + OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le"), np.uint32)
    out = np.zeros(FEATURES, np.int64)
    for n in (1, 2, 3):
        for start in range(0, max(len(c) - n + 1, 0), PART):
            x = c[start : start + PART + n - 1]
            h = np.full(len(x) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h * np.uint32(0x9E3779B1)) ^ x[i : len(x) - n + 1 + i]
            h *= np.uint32(0x85EBCA77)
            out += np.bincount(h >> np.uint32(32 - 14), minlength=FEATURES)
    return out


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    out = counts(text)
    at = np.flatnonzero(out)
    return at, out[at]


def weighted(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(n) * idf
    return x / max(np.sqrt(x @ x), 1e-12)


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0
        at, n = sparse(text)
        x = weighted(n, self.idf[at])
        p = softmax((x @ self.weights[at] + self.bias)[None] / self.temperature)[0]
        return self.langs[int(p.argmax())], float(min(1.0, p.max()))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    rows = [sparse(t) for t in texts]
    seen = np.bincount(np.concatenate([at for at, _ in rows]), minlength=FEATURES)
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    idf[seen < 2] = 0  # a column of one text tells nothing

    def dense(part: np.ndarray) -> np.ndarray:
        x = np.zeros((len(part), FEATURES + 1), np.float32)
        x[:, -1] = 1
        for i, k in enumerate(part):
            at, n = rows[k]
            x[i, at] = weighted(n, idf[at])
        return x

    y = np.array([names.index(x) for x in langs])
    kept, calib = np.flatnonzero(np.arange(len(y)) % 5 != 0), np.flatnonzero(np.arange(len(y)) % 5 == 0)
    kept = kept if len(kept) else calib
    shape = (FEATURES + 1, len(names))
    z, n, w = (np.zeros(shape) for _ in range(3))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for part in np.array_split(order.permutation(kept), max(1, len(kept) // ROWS)):
            x = dense(part)
            error = softmax(x @ w)
            error[np.arange(len(part)), y[part]] -= 1
            g = x.T @ error / len(part)
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
            z += g - sigma * w
            n += g * g
            w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    logits = np.concatenate([dense(part) @ w for part in np.array_split(calib, max(1, len(calib) // ROWS))])
    return Model(names, idf, w[:-1].astype(np.float32), w[-1], temperature(logits, y[calib]))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over the logarithm.

    The true class counts as (n + 1) / (n + 2) of a row, the others share the rest, as after one more row of each outcome:
    so rows that are all predicted rightly don't ask for certainty, and the minimum lies inside the range."""
    n, k = logits.shape
    if k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + 2) / (k - 1))
    target[np.arange(n), y] = (n + 1) / (n + 2)
    spread = max(float(np.ptp(logits, axis=1).mean()), 1e-9)

    def loss(log_t: float) -> float:
        z = logits / (spread * np.exp(log_t))
        z = z - z.max(1, keepdims=True)
        return float((target * (np.log(np.exp(z).sum(1, keepdims=True)) - z)).sum(1).mean())

    lo, hi, ratio = -12.0, 12.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return spread * float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("lang is not null").filter(remainder("doc_id") != 0).filter(F.length("text").between(1, sample_chars))
    got = sorted(map(tuple, class_sample(rows, "doc_id", "lang", sample).select("doc_id", "text", "lang").collect()), key=lambda r: (r[0] is None, r))
    if not got:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 1), np.float32), np.zeros(1), 1.0)
    return train([t for _, t, _ in got], [x for _, _, x in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**shared.value)
        for b in batches:
            found = [own.predict(t) for t in b.column(2).to_pylist()]
            yield batch({"doc_id": (b.column(0), pa.int64()), "held_out": (b.column(1), pa.bool_()), "lang_pred": ([x for x, _ in found], pa.string()), "score": ([p for _, p in found], pa.float64())})

    return arrow_map(docs.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))

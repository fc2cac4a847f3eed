"""Toxicity by FTRL-proximal logistic regression (operator 5).

Features are hashed word n-grams (one and two words), skip-grams (two words with
one between them) and the words' first PREFIXES bytes (stems of inflected words) of
the whole text. A feature that occurs twice or three times in a document adds a
feature of its own for that. Every coordinate has its own learning rate, and the L1 term keeps the weights of uninformative features at
exactly zero, so what is broadcast is a short list of (index, weight).

At most TRAIN_ROWS labelled rows are learned from (a bounded sample by hash of the
id); everything else covers all rows. Cases: null and empty texts have no features
and score the intercept; without training rows the score is 0; repeated rows score
alike; a text of any length is scored whole, in memory proportional to it; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, ascii_lower, held_out, mix, remove, row_chunks, trim, word_bounds, word_hashes
from .sampling import training_rows

BITS = 20
PREFIXES = (4, 5, 6, 7)
TRAIN_ROWS = 12_000
THRESHOLD = 0.7
#: Bytes of text whose features are held at once.
CHUNK = 1 << 18


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and index of every n-gram and skip-gram, repeats included."""
    rows, starts, ends = word_bounds(data, offsets, ALNUM)
    data = ascii_lower(data)
    words = word_hashes(data, starts, ends)
    out_rows, out = [rows], [mix(words ^ U64(1))]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = rows[gap:] == rows[:-gap] if len(rows) > gap else np.zeros(0, bool)
        pair = mix(words[: len(same)] * U64(salt) + words[gap : gap + len(same)])
        out_rows.append(rows[: len(same)][same])
        out.append(pair[same])
    for size in PREFIXES:
        longer = ends - starts > size
        out_rows.append(rows[longer])
        out.append(mix(word_hashes(data, starts[longer], starts[longer] + size) ^ U64(size + 1)))
    return np.concatenate(out_rows), (np.concatenate(out) >> U64(64 - bits)).astype(np.int64)


def repeated(at: np.ndarray, times: int, bits: int = BITS) -> np.ndarray:
    """The feature that stands for ``times`` or more occurrences of each feature."""
    return (mix(at.astype(U64) + U64(times << 40)) >> U64(64 - bits)).astype(np.int64)


def with_repeats(pairs: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distinct (row << bits | feature) of all pairs, with those for repeats."""
    pairs, counts = np.unique(pairs, return_counts=True)
    out = [pairs]
    for times in (2, 3):
        many = pairs[counts >= times]
        out.append((many >> bits << bits) | repeated(many & (2**bits - 1), times, bits))
    return np.unique(np.concatenate(out))


class FTRL:
    def __init__(self, bits: int = BITS, alpha: float = 0.2, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def intercept(self) -> float:
        """The last coordinate: no L1, so that the base rate is always learned."""
        return -self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.intercept()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        n = self.n[-1]
        self.z[-1] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * b
        self.n[-1] = n + g * g


def fit(examples: Iterable[tuple[np.ndarray, int]], epochs: int = 4, bits: int = BITS, **how) -> FTRL:
    model, examples = FTRL(bits, **how), list(examples)
    for _ in range(epochs):
        for at, label in examples:
            model.learn(at, label)
    return model


def _examples(texts: list[str], bits: int) -> list[np.ndarray]:
    """The features of each text, as parts of larger arrays of four-byte numbers."""
    out: list[np.ndarray] = []
    for i, j, data, offsets in row_chunks(pa.array(texts, pa.string()), CHUNK):
        rows, found = features(data, offsets, bits)
        pairs = with_repeats((rows << bits) | found, bits)
        at = (pairs & (2**bits - 1)).astype(np.int32)
        out += np.split(at, np.searchsorted(pairs >> bits, np.arange(1, j - i)))
        texts[i:j] = [""] * (j - i)  # not needed any more
    return out


def train(sample: DataFrame, bits: int = BITS, **how) -> tuple[np.ndarray, float]:
    """Weights and intercept, fitted in one task over the bounded sample."""

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "doc_id"])
        texts = rows.pop("text").tolist()
        model = fit(zip(_examples(texts, bits), rows.label.tolist(), strict=True), bits=bits, **how)
        w = model.weights(slice(0, -1))
        at = np.flatnonzero(w)
        trim()
        return pd.DataFrame({"at": np.append(at, -1), "w": np.append(w[at], model.intercept())})

    found = sample.groupBy(F.lit(0).alias("all")).applyInPandas(fitted, "at long, w double").toPandas()
    weights, bias = np.zeros(2**bits, np.float32), -20.0
    if len(found):
        inner = found["at"].to_numpy() >= 0
        weights[found["at"].to_numpy()[inner]] = found["w"].to_numpy()[inner]
        bias = float(found["w"].to_numpy()[~inner][0])
    return weights, bias


def scorer(docs: DataFrame, labels: DataFrame, folds: int, bits: int, bound: int):
    """A function from a column of texts to their scores, with the fitted weights broadcast."""
    sample = training_rows(docs, labels, "toxic", folds, bound, "toxic")
    weights, bias = train(sample, bits)
    remove(sample)
    at = np.flatnonzero(weights)
    model = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at], bias))

    def prepared():
        at, w, bias = model.value
        weights = np.zeros(2**bits, np.float32)
        weights[at] = w
        every = np.arange(2**bits)
        useful = (weights != 0) | (weights[repeated(every, 2, bits)] != 0) | (weights[repeated(every, 3, bits)] != 0)

        def score(texts: pa.Array) -> np.ndarray:
            out = np.full(len(texts), bias)
            for i, j, data, offsets in row_chunks(texts, CHUNK):
                rows, found = features(data, offsets, bits)
                kept = useful[found]
                pairs = with_repeats((rows[kept] << bits) | found[kept], bits)
                out[i:j] += np.bincount(pairs >> bits, weights[pairs & (2**bits - 1)], j - i)
            return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

        return score

    return prepared


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, threshold: float = THRESHOLD, bits: int = BITS, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    prepared = scorer(docs, labels, folds, bits, bound)

    def scan(batches):
        score = prepared()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)))], ["doc_id", "score"])
        trim()

    key = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {key}, score double")
    return scored.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 3, threshold: float = THRESHOLD, bits: int = BITS, bound: int = TRAIN_ROWS) -> DataFrame:
    """The documents that the classifier doesn't call toxic, with their own columns; they
    are judged where they lie, each row by its own text."""
    prepared, at = scorer(docs, labels, folds, bits, bound), docs.columns.index("text")

    def scan(batches):
        score = prepared()
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at)) < threshold))
        trim()

    return docs.mapInArrow(scan, docs.schema)

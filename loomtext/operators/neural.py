"""A small text network trained here, and batched inference with it or any other encoder.

Words and word pairs are hashed to rows of an embedding table; their mean is a text's code, a
linear layer gives its classes. Training runs over a bounded labelled sample and keeps the
epoch with the best macro F1 on the validation rows. Inference sorts each Arrow batch by
length and runs it in small batches; the model is broadcast once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A function from texts to one row of numbers for each.
Encoder = Callable[[Sequence[str]], np.ndarray]


def _features(text: str | None, size: int, longest: int) -> np.ndarray:
    words = re.findall(r"\w+", (text or "").lower())[:longest]
    grams = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]
    return np.array([zlib.crc32(g.encode()) % size for g in grams], np.int64)


def macro_f1(truth: np.ndarray, guess: np.ndarray, classes: int) -> float:
    hit, a, b = (np.bincount(x, minlength=classes) for x in (truth[truth == guess], truth, guess))
    return float(np.mean(2 * hit / np.maximum(a + b, 1)))


class TextNet:
    """``longest``: words of a text that count (a parameter of the method, as in any encoder)."""

    def __init__(self, classes: int, size: int = 1 << 14, width: int = 32, longest: int = 256, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.size, self.longest, self.classes = size, longest, classes
        self.table, self.out, self.bias = rng.normal(0, 0.1, (size, width)), np.zeros((width, classes)), np.zeros(classes)

    def code(self, texts: Sequence[str]) -> np.ndarray:
        """A text's mean row; zeros without words."""
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, t in enumerate(texts):
            at = _features(t, self.size, self.longest)
            if len(at):
                out[i] = self.table[at].mean(0)
        return out

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        """Codes of length one."""
        x = self.code(texts)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def probabilities(self, texts: Sequence[str]) -> np.ndarray:
        z = self.code(texts) @ self.out + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradients(self, features: list[np.ndarray], labels: np.ndarray):
        """Of the mean loss: by table row (rows, their gradients), of the layer and its bias."""
        code = np.stack([self.table[f].mean(0) if len(f) else np.zeros(self.table.shape[1]) for f in features])
        z = code @ self.out + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - np.eye(self.classes)[labels]) / len(labels)
        back = d @ self.out.T
        rows = np.concatenate([*features, np.zeros(0, np.int64)])
        own = np.repeat(np.arange(len(features)), [len(f) for f in features])
        size = np.array([max(len(f), 1) for f in features])
        unique, inverse = np.unique(rows, return_inverse=True)
        table = np.zeros((len(unique), self.table.shape[1]))
        np.add.at(table, inverse, back[own] / size[own, None])
        return unique, table, code.T @ d, d.sum(0)

    def fit(self, texts: Sequence[str], labels: Sequence[int], held: Sequence[str], held_labels: Sequence[int], epochs: int = 5, batch: int = 8, rate: float = 0.5, seed: int = 42) -> tuple[int, list[float]]:
        """The best epoch (from 1) and every epoch's macro F1 on the held rows; its weights stay."""
        rng, y, scores = np.random.default_rng(seed), np.array(labels), []
        features, best = [_features(t, self.size, self.longest) for t in texts], None
        squares = np.full(self.size, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                rows, table, out, bias = self.gradients([features[k] for k in part], y[part])
                squares[rows] += (table * table).mean(1)
                self.table[rows] -= rate * 0.1 * table / np.sqrt(squares[rows])[:, None]
                self.out -= rate * out
                self.bias -= rate * bias
            scores.append(macro_f1(np.array(held_labels), self.probabilities(held).argmax(1), self.classes) if len(held) else 0.0)
            if best is None or scores[-1] > scores[best[0]]:
                best = (len(scores) - 1, self.table.copy(), self.out.copy(), self.bias.copy())
        if best:
            _, self.table, self.out, self.bias = best
        return (best[0] + 1 if best else 0), scores


def infer(df: DataFrame, text: str, encoder: Encoder, name: str = "vector", batch: int = 32) -> DataFrame:
    """df with the encoder's numbers for each text (array of doubles); texts of like length run together."""
    shared = df.sparkSession.sparkContext.broadcast(encoder)
    at, names = df.columns.index(text), [*df.columns, name]

    def scan(batches):
        run = shared.value
        for rows in batches:
            texts = [t or "" for t in rows.column(at).to_pylist()]
            order, out = sorted(range(len(texts)), key=lambda i: len(texts[i])), [None] * len(texts)
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                for k, v in zip(part, run([texts[j] for j in part]), strict=True):
                    out[k] = [float(x) for x in v]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.list_(pa.float64()))], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(scan, f"{kinds}, `{name}` array<double>")


def train(df: DataFrame, text: str, label: str, held: str, classes: int, bound: int = 5000, row_id: str = "doc_id", **how) -> tuple[TextNet, int, list[float]]:
    """A network, its best epoch and all epochs' scores, from at most ``bound`` labelled rows in the
    order of a hash of their id; ``held`` marks those that choose the epoch."""
    rows = df.where(F.col(label).isNotNull()).orderBy(F.xxhash64(row_id), row_id).limit(bound)
    sample = rows.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"), F.col(held).alias("h")).toPandas()
    net, own = TextNet(classes, seed=how.pop("seed", 42)), ~sample["h"].astype(bool)
    best, scores = net.fit(sample.loc[own, "t"].tolist(), sample.loc[own, "y"].tolist(), sample.loc[~own, "t"].tolist(), sample.loc[~own, "y"].tolist(), **how)
    return net, best, scores

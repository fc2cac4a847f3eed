"""Quality by attention-based multiple-instance learning (operator 9).

A document is a bag of passages (lines, long ones cut near PASSAGE bytes). Each
passage is encoded by a small learned layer over its byte-class statistics and its words,
hashed to WORDS counts; gated attention (tanh times sigmoid) weighs the passages, and the
weighted mean of their codes gives the logit. Only documents have labels; which passage
decides is learned.

At most TRAIN_ROWS labelled rows are learned from (a bounded sample by hash of the
id). Cases: null and empty texts are one empty passage; without training rows the
score is 0.5; repeated rows (and of a repeated id each text) score by their own text; a
text of any length is scored whole, in memory proportional to it; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, held_out, remove, row_chunks, trim, word_bounds, word_hashes
from .sampling import training_rows

PASSAGE = 512
TRAIN_ROWS = 12_000
THRESHOLD = 0.5

_GROUPS = ("\n\r", " \t", ".", ",;:", "!?", "|", "#$%&*@^~", "\"'`", "()[]{}<>", "-_/\\+=")
_CLASS = np.full(256, 15, np.uint8)
for _n, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _n
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B] = 10, 11, 12
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 13, 14
EXTRA, WORDS = 6, 64
WIDTH = 16 * 16 + 16 + EXTRA + WORDS


def passages(data: np.ndarray, offsets: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Row and start of each passage; every row has one at least."""
    rows_start = offsets[:-1]
    lines = np.flatnonzero(data == 10) + 1
    starts = np.unique(np.concatenate([rows_start, lines[lines < len(data)]]))
    ends = np.append(starts[1:], len(data))
    pieces = np.maximum(1, -(-(ends - starts) // size))
    step = -(-(ends - starts) // pieces)
    inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(starts, pieces) + inner * np.repeat(step, pieces)
    starts = starts[starts < len(data)]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    bare = np.setdiff1d(np.arange(len(offsets) - 1), rows)  # rows without bytes
    order = np.argsort(np.concatenate([rows, bare]), kind="stable")
    return np.concatenate([rows, bare])[order], np.concatenate([starts, offsets[bare]])[order]


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each passage and its WIDTH statistics."""
    rows, starts = passages(data, offsets)
    n = len(starts)
    ends = np.append(starts[1:], len(data))
    length = ends - starts
    x = np.zeros((n, WIDTH), np.float32)
    if len(data):
        own = np.repeat(np.arange(n), length)
        kind = _CLASS[data].astype(np.int64)
        x[:, :16] = np.bincount(own * 16 + kind, minlength=n * 16).reshape(n, 16)
        inside = own[1:] == own[:-1]
        step = own[1:] * 256 + kind[:-1] * 16 + kind[1:]
        x[:, 16:272] = np.bincount(step[inside], minlength=n * 256).reshape(n, 256)
        x[:, :272] /= np.maximum(length, 1)[:, None]
        _, w_start, w_end = word_bounds(data, offsets, ALNUM)
        w_own = own[w_start]
        words = np.bincount(w_own, minlength=n)
        hashes = word_hashes(data, w_start, w_end)
        order = np.lexsort((hashes, w_own))
        again = np.append(False, (hashes[order][1:] == hashes[order][:-1]) & (w_own[order][1:] == w_own[order][:-1]))[: len(order)]
        total = np.zeros(n, U64)
        np.add.at(total, w_own, hashes)
        order_p = np.lexsort((total, rows))
        twin = np.zeros(n, bool)
        twin[order_p[1:]] = (total[order_p][1:] == total[order_p][:-1]) & (rows[order_p][1:] == rows[order_p][:-1]) & (words[order_p][1:] > 2)
        x[:, 272] = np.bincount(w_own[order][again], minlength=n) / np.maximum(words, 1)
        x[:, 273] = np.bincount(w_own, w_end - w_start, n) / np.maximum(words, 1) / 10
        x[:, 274] = twin
        x[:, 275] = np.log1p(words) / 5
        bucket = w_own * WORDS + (hashes % U64(WORDS)).astype(np.int64)
        x[:, 278:] = np.bincount(bucket, minlength=n * WORDS).reshape(n, WORDS) / np.maximum(words, 1)[:, None]
    x[:, 276] = np.log1p(np.bincount(rows, length, len(offsets) - 1))[rows] / 10
    x[:, 277] = 1
    return rows, x


class GatedAttention:
    """h = tanh(W x); a = softmax(w . tanh(V h) * sigmoid(U h)); logit = c . sum(a h) + b."""

    SHAPES = (("W", (WIDTH, 24)), ("V", (24, 12)), ("U", (24, 12)), ("w", (12,)), ("c", (24,)), ("b", (1,)))

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for k, s in self.SHAPES}
        self.p["W"] *= 6
        self.p["b"][:] = 0

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """first: index of each bag's first passage."""
        p, own = self.p, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        h = np.tanh(x @ p["W"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[own])
        a = e / np.add.reduceat(e, first)[own]
        z = np.add.reduceat(a[:, None] * h, first)
        return own, h, t, s, a, z, z @ p["c"] + p["b"][0]

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        p = self.p
        own, h, t, s, a, z, logit = self.forward(x, first)
        d = (1 / (1 + np.exp(-logit)) - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (h * dz[own]).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[own])
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz[own] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ d, "b": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 11) -> GatedAttention:
        rng, m, v, n = np.random.default_rng(seed), {k: 0 for k in self.p}, {k: 0 for k in self.p}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(bags), batch):
                part, n = order[i : i + batch], n + 1
                sizes = [len(bags[k]) for k in part]
                grads = self.gradients(np.concatenate([bags[k] for k in part]), np.cumsum([0, *sizes[:-1]]), y[part])
                for k, g in grads.items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    step = rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)
                    self.p[k] = (self.p[k] * (1 - decay) - step).astype(np.float32)
        return self

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, x = encode(data, offsets)
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        return 1 / (1 + np.exp(-np.clip(self.forward(x, first)[-1].astype(np.float64), -35, 35)))


def train(sample: DataFrame) -> GatedAttention | None:
    """The model, fitted in one task over the bounded sample; None without rows."""

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "doc_id"])
        bags: list[np.ndarray] = []  # parts of larger arrays
        for i, j, data, offsets in row_chunks(pa.array(rows.text.tolist(), pa.string())):
            own, x = encode(data, offsets)
            bags += np.split(x, np.searchsorted(own, np.arange(1, j - i)))
        model = GatedAttention().fit(bags, rows.label.to_numpy(np.float32))
        del bags
        trim()
        return pd.DataFrame({"name": list(model.p), "value": [p.tobytes() for p in model.p.values()]})

    found = {r.name: r.value for r in sample.groupBy(F.lit(0).alias("all")).applyInPandas(fitted, "name string, value binary").collect()}
    if not found:
        return None
    model = GatedAttention()
    model.p = {k: np.frombuffer(found[k], np.float32).reshape(s) for k, s in GatedAttention.SHAPES}
    return model


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, threshold: float = THRESHOLD, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    sample = training_rows(docs, labels, "quality", folds, bound, "quality")
    model = docs.sparkSession.sparkContext.broadcast(train(sample))
    remove(sample)

    def scan(batches):
        net = model.value
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            for i, j, data, offsets in row_chunks(batch.column(1), 1 << 19) if net else ():
                score[i:j] = net.score(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    key = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {key}, score double")
    return scored.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

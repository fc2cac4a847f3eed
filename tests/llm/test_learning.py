"""The two classifiers against plain versions of their formulas."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import quality, toxicity
from loomtext.llm.common import row_chunks
from loomtext.llm.sampling import training_rows


def plain_ftrl(examples, epochs, alpha=0.2, beta=1.0, l1=8.0, l2=1.0):
    """FTRL-proximal one coordinate at a time, from the published update."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if i == "bias":
            return -zi / ((beta + math.sqrt(n.get(i, 0.0))) / alpha)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for features, label in examples:
            own = [*features, "bias"]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in own:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return weight, z


def test_ftrl_by_the_plain_update():
    rng = random.Random(1)
    examples = []
    for _ in range(300):
        label = rng.randint(0, 1)
        examples.append((np.unique([int(rng.paretovariate(0.5)) % 100 + 100 * (label and rng.random() < 0.8) for _ in range(12)]), label))
    model = toxicity.fit(examples, epochs=3, bits=8, l1=3.0)
    weight, z = plain_ftrl([(x.tolist(), y) for x, y in examples], 3, l1=3.0)
    w = model.weights(slice(0, -1))
    assert [w[i] for i in range(200)] == pytest.approx([weight(i) for i in range(200)], abs=1e-9)
    assert model.intercept() == pytest.approx(weight("bias"), abs=1e-9)
    assert any(abs(z.get(i, 0)) and not w[i] for i in range(200)) and any(w)


def test_scores_are_sums_of_the_weights(spark):
    """Every score against the model's own weights, summed one feature at a time."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) + (" Foul, foul thing" if i % 3 == 0 else "")) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "foul " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    weights, bias = toxicity.train(training_rows(docs, labels, "toxic", 3, 12_000, "toxic"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    for i, t in rows:
        (own,) = toxicity._examples([t or ""], toxicity.BITS)
        logit = bias + sum(float(weights[k]) for k in set(own.tolist()))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == int(got[i].score >= 0.7)
    assert got[502].predicted == 1 and got[500].score == got[501].score


def test_features_are_the_grams_of_the_text():
    """As many features as words, pairs, skips and stems, each its own."""
    data = b"One two, three four"
    _, at = toxicity.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    stems = sum(len(w) > k for w in data.decode().replace(",", "").split() for k in toxicity.PREFIXES)
    assert len(at) == 4 + 3 + 2 + stems == len(set(at.tolist()))
    same = b"ONE TWO three -- FOUR"
    _, other = toxicity.features(np.frombuffer(same, np.uint8), np.array([0, len(same)]))
    assert at.tolist() == other.tolist()


def bags(rng, n):
    return [rng.normal(size=(int(rng.integers(1, 5)), quality.WIDTH)).astype(np.float64) for _ in range(n)]


def doubled():
    net = quality.GatedAttention()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def test_attention_by_the_plain_formula():
    rng, net = np.random.default_rng(3), doubled()
    xs = bags(rng, 6)
    logits = net.forward(np.concatenate(xs), np.cumsum([0, *map(len, xs[:-1])]))[-1]
    p = net.p
    for x, logit in zip(xs, logits, strict=True):
        codes = [np.tanh(row @ p["W"]) for row in x]
        raw = [float(p["w"] @ (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"]))))) for h in codes]
        share = [math.exp(e) / sum(map(math.exp, raw)) for e in raw]
        z = sum(a * h for a, h in zip(share, codes, strict=True))
        assert logit == pytest.approx(float(z @ p["c"] + p["b"][0]), abs=1e-9)


def test_gradients_by_finite_differences():
    rng, net = np.random.default_rng(4), doubled()
    xs = bags(rng, 5)
    x, first, y = np.concatenate(xs) * 0.1, np.cumsum([0, *map(len, xs[:-1])]), np.array([0.0, 1, 1, 0, 1])

    def loss():
        logit = net.forward(x, first)[-1]
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    grads = net.gradients(x, first, y)
    for name, value in net.p.items():
        flat = value.reshape(-1)
        for at in rng.integers(0, flat.size, 12):
            old, step = flat[at], 1e-5
            flat[at] = old + step
            up = loss()
            flat[at] = old - step
            down = loss()
            flat[at] = old
            assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-8)


def test_passages_and_their_statistics():
    texts = ["one two\nthree four five\n" + "x" * 1200, "", "só"]
    (_, _, data, offsets), *_ = row_chunks(pa.array(texts))
    rows, x = quality.encode(data, offsets)
    assert rows.tolist() == [0] * 5 + [1, 2]
    assert x[0, :16].sum() == pytest.approx(1) and x[5, :278].sum() == x[5, 277] == 1
    assert x[0, 278:].sum() == pytest.approx(1) and x[1, 275] == pytest.approx(math.log1p(3) / 5)


def test_words_alone_can_decide(spark):
    """Texts alike in all but which words they use."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["abc", "bca", "cab"] if i % 2 else ["acb", "bac", "cba"]) for _ in range(40))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    held = [r for r in quality.score_quality(docs, labels).collect() if r.held_out]
    assert sum(r.predicted == r.doc_id % 2 for r in held) > 0.97 * len(held)


def test_the_sample_is_bounded(spark):
    rows = [(i % 50, f"text {i} " + "y" * 100) for i in range(2000)] + [(60, "z" * 5000), (61, None), (None, "lost")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(70)] + [(3, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    free = [i for i in (*range(50), 60, 61) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(r.doc_id for r in training_rows(docs, labels, "toxic", 3, 1000, "s").collect()) == free
    few = training_rows(docs, labels, "toxic", 3, 1000, "s", max_bytes=1000).collect()
    assert sum(len(r.text) for r in few) <= 1000 and len(few) >= 8 and 60 not in {r.doc_id for r in few}
    assert len(training_rows(docs, labels, "toxic", 3, 5, "s").collect()) <= 5

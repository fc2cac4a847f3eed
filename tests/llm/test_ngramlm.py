"""The trigram model against plain dictionaries."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loomtext.llm import ngramlm

WORDS = [f"w{i}" for i in range(60)]
SCHEMA = "doc_id long, text string, n long, key string"


def corpus():
    rng = random.Random(11)
    rows = [(i, " ".join(WORDS[int(rng.paretovariate(0.6)) % 60] for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(900, None), (901, "never seen"), (902, "w1 " * 700), (903, "Ä x"), (904, "w1 w2 w3 " * 300), (None, "w5 w6")]
    return rows + [(1, rows[1][1]), (1000, rows[2][1])]


def plain(trained):
    """The model's probability function from the definitions."""
    c = Counter(w for t in trained for w in t)
    tri = Counter(x for t in trained for x in zip(["<s>", "<s>", *t], ["<s>", *t], t, strict=False))
    lefts = Counter((v, w) for _, v, w in tri)
    k = Counter(w for _, w in lefts)

    def discount(counts):
        n1, n2, n3, n4 = (sum(x == j for x in counts.values()) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        return {1: min(max(1 - 2 * y * n2 / n1, 0), 1), 2: min(max(2 - 3 * y * n3 / n2, 0), 2), 3: min(max(3 - 4 * y * n4 / n3, 0), 3)}

    d3, d2, d1 = discount(tri), discount(lefts), discount(k)
    unknown = sum(d1[min(x, 3)] for x in k.values()) / len(lefts) / (len(c) + 1)

    def level(counts, cut, context, word, lower):
        own = {x[-1]: n for x, n in counts.items() if x[:-1] == context}
        if not own:
            return lower
        total = sum(own.values())
        back = sum(cut[min(n, 3)] for n in own.values()) / total
        n = own.get(word, 0)
        return (n - cut[min(n, 3)] if n else 0) / total + back * lower

    def p(u, v, w):
        one = (k[w] - d1[min(k[w], 3)]) / len(lefts) + unknown if k[w] else unknown
        return level(tri, d3, (u, v), w, level(lefts, d2, (v,), w, one))

    return c, p


@pytest.mark.parametrize("size", [1 << 20, 400])
def test_model_by_brute_force(spark, size, monkeypatch):
    """In one bucket, and in many with frequent middle words dealt in parts."""
    rows = corpus()
    words = lambda t: [*(t or "").split(" "), "</s>"] if (t or "").strip() else ["</s>"]
    lower = lambda t: None if t is None else "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t).strip(" ")
    trained = [words(lower(t)) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c, p = plain(trained)
    n, distinct = sum(c.values()), len(c)
    got = ngramlm.score_texts(spark.createDataFrame([(*r, 1, "own") for r in rows], SCHEMA), size=size).collect()
    assert len(got) == len(rows)
    by_id = {i: words(lower(t)) for i, t in rows}
    for r in got:
        t = by_id[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (distinct + 1))) for w in t), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p(*x)) for x in zip(["<s>", "<s>", *t], ["<s>", *t], t, strict=False)), rel=1e-9)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


def hashed(word):
    data = word.encode()
    return ngramlm.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1][0]


def test_probabilities_sum_to_one(spark):
    """Over the vocabulary, the end and one unknown word, after contexts of each kind."""
    docs = spark.createDataFrame([(t,) for _, t in corpus()], "text string").na.fill("")
    model = ngramlm.train(docs, size=400)
    vocabulary = [hashed(w) for w in {w for (t,) in docs.collect() for w in t.split(" ") if w}] + [hashed("nowhere")]
    for context in ("", "w1", "w1 w2", "w59 nowhere", "nowhere w1"):
        past = [hashed(w) for w in context.split()]
        total = 0.0
        for word in [*vocabulary, ngramlm.END]:
            found = np.array([*past, word], np.uint64)
            scores = [model.score(np.zeros(len(x), np.int64), x, 1)[3][0] if len(x) else 0.0 for x in (found, found[:-1])]
            total += 10 ** (scores[0] - scores[1])
        assert total == pytest.approx(1, abs=1e-9)


def test_empty_table(spark):
    assert ngramlm.score_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = ngramlm.score_texts(spark.createDataFrame([(held, "a b", 1, "x")], SCHEMA)).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0)


def test_a_word_and_a_text_of_any_length(spark):
    rows = [(1, "x" * 700_000 + " y"), (2, "a b c " * 60_000), (3, "a b c"), (5, "x" * 700_000)]
    got = {r.doc_id: r for r in ngramlm.score_texts(spark.createDataFrame([(*r, 1, "own") for r in rows], SCHEMA), size=5000).collect()}
    assert [got[i].n_tokens for i in (1, 2, 3, 5)] == [3, 180_001, 4, 2]
    assert got[2].perplexity < 1.1 and got[5].n_known == 2

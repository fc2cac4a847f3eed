"""Vocabularies, dictionaries and models that take all there is, not what a bound leaves."""

import random

import numpy as np
import pytest

import __spark_entry__
from loomtext.operators import attitude, grams, topics


def test_the_dictionary_of_segments_has_every_word(spark, tmp_path):
    """50,176 words of two Han characters, each in 20 texts: one beyond the dictionary falls apart
    into single characters, which aren't kept."""
    text = " ".join(chr(0x4E00 + i) + chr(0x5E00 + j) for i in range(224) for j in range(224))
    spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.kept for r in __spark_entry__.queries()["segment_words"](spark, str(tmp_path)).collect()} == {224 * 224}


def test_the_vocabulary_of_topics_has_every_word(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters[:15] for b in letters for c in letters for d in letters]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(5)] + [(5, "other")], "doc_id long, text string")
    assert topics.vectorised(docs)[0] == words and len(words) > 1 << 18


def test_the_batch_model_takes_every_word_and_pass(spark, tmp_path, monkeypatch):
    words = [f"{chr(97 + i // 26 // 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}w{chr(97 + j)}" for i in range(26 * 26 * 26) for j in range(2)]
    rows = [(i, " ".join(words)) for i in range(10)] + [(10 + i, "other") for i in range(11)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    steps, step = [], topics.BatchLDA.step
    monkeypatch.setattr(topics.BatchLDA, "step", lambda self, rows: steps.append(self.components.shape) or (step(self, rows) if len(steps) < 2 else self.components))
    out = __spark_entry__.queries()["lda_fit_batch"](spark, str(tmp_path)).collect()
    assert len(out) == 120 and steps == [(12, len(words))] * 50


@pytest.mark.parametrize("local", [1 << 24, 0])
def test_all_labelled_rows_are_learned_from(spark, tmp_path, monkeypatch, local):
    """The scores are those at the optimum over all of 700 rows, found on the driver or by the tasks."""
    monkeypatch.setattr(grams, "LOCAL", local)
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["good fine", "bad sad", "plain so even"][i % 3].split() + ["a", "of", f"x{i % 50}"]) for _ in range(rng.randint(0, 12)))) for i in range(700)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in __spark_entry__.queries()["logreg_scores"](spark, str(tmp_path)).collect()}
    rows = attitude.char_tfidf(docs, "doc_id", "text").toPandas()
    names = sorted(rows["gram"].unique())
    x = np.zeros((700, len(names)))
    x[rows["doc_id"], np.searchsorted(names, rows["gram"])] = rows["weight"]
    y = np.array([1 if i % 5 == 0 else -1 if i % 3 == 0 else 0 for i in range(700)])
    model = attitude.balanced_logistic(x @ x.T, y)
    best = model.probabilities(x @ x.T)
    assert len(got) == 700 and all([r.p_neg, r.p_neutral, r.p_pos] == pytest.approx(best[i], abs=1e-4) for i, r in got.items())
    assert all(r.polarity == pytest.approx(best[i][2] - best[i][0], abs=2e-4) for i, r in got.items())

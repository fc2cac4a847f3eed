"""Licence placements against a plain search of every start."""

import random

import pytest

from loomtext.llm import licence_texts, licenses
from loomtext.llm.common import alnum_words

RNG = random.Random(12)
FILLER = [f"v{i}" for i in range(300)]


def filler(n):
    return " ".join(RNG.choice(FILLER) for _ in range(n))


def damaged(text, n):
    """Words put in, left out or changed at n places."""
    words = text.split()
    for _ in range(n):
        at = RNG.randrange(1, len(words) - 1)
        words[at : at + 1] = RNG.choice([[words[at], "inserted"], [], ["changed"]])
    return " ".join(words)


def plain(index, words):
    """Label and best share over all starts, without postings."""
    found = {}
    for n, (label, own, _) in enumerate(index.templates):
        for start in range(-licenses.BAND, len(words), licenses.BAND):
            share = index.confirmed(n, words, start)
            if share:
                found[label] = max(found.get(label, 0.0), share)
    return found


def test_placements_by_brute_force(spark):
    rows = []
    for i, (_, text, _) in enumerate(licence_texts.TEMPLATES):
        rows.append((10 * i, filler(40 + i) + " " + text + " " + filler(30)))
        rows.append((10 * i + 1, filler(7 * i % 90) + " " + damaged(text, max(1, len(text.split()) // 40)) + " " + filler(10)))
    rows += [(9000 + i, filler(80)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = licenses.vocabulary()
    n, df = licenses.document_frequency(docs, vocab)
    index = licenses.Index({w: licenses.math.log((1 + n) / (1 + df.get(w, 0))) for w in vocab})
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, t in rows:
        words = alnum_words(t.encode())
        want = plain(index, words)
        base = set(filter(None, got[i].base_labels.split(",")))
        found = set(filter(None, got[i].labels.split(",")))
        assert {k for k, share in want.items() if share > 0.9} | base <= found <= set(want) | base  # parts far apart can lack votes
        assert got[i].score == pytest.approx(max([*want.values(), 0.5 if base else 0.0], default=0.0), abs=0.05)
    for i, (label, _, _) in enumerate(licence_texts.TEMPLATES):
        assert label in got[10 * i].labels.split(",") and got[10 * i].score == 1.0


@pytest.mark.parametrize(
    "text, label",
    [
        ("Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met:", "bsd"),
        ("under the GNU General Public License, either version 3 of the License, or any later version.", "gpl-3.0"),
        (licence_texts.MIT_GRANT.replace("free of charge", "wholly free of charge"), "mit"),
    ],
)
def test_a_word_more_does_no_harm(spark, text, label):
    rows = [(1, text)] + [(i, filler(50)) for i in range(2, 20)]
    row = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 1").first()
    assert label in row.labels.split(",") and row.score > 0.85


def test_key_phrases_are_mandatory(spark):
    text = licence_texts.MIT_GRANT.replace("without restriction", "with restrictions")
    rows = [(1, text)] + [(i, filler(50)) for i in range(2, 20)]
    row = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 1").first()
    assert (row.labels, row.score) == ("", 0.0)

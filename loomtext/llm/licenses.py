"""Licence scans by a positional rare-token index (operator 7).

Whole licence texts and their usual notices are cut into passages; each passage is
indexed by its rarest words: the ANCHORS words of highest inverse document frequency,
counted over all documents. A file looks up its own occurrences of those words;
postings whose position relative to the file lies in one band (two overlapping bands
of BAND words, so words put in or left out don't split a placement) vote for one
placement of the template. A placement with VOTES of the anchors' weight is confirmed
if the template's mandatory key phrases stand there and MATCH of its words do in order.

Base labels come from three fixed phrases and are always kept. The score is the
best placement's share of matching words, at least 0.5 if a base phrase occurs.
Cases: null and empty texts have no words and score 0; repeated rows are separate; a
text of any length is scanned whole, in memory proportional to it; ties between
placements of a label take the better share; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, byte_column
from .licence_texts import TEMPLATES

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Anchors for each passage of so many words.
ANCHORS, PASSAGE = 4, 32
#: A placement may drift by one or two bands of so many words against the template.
BAND = 16
#: Share of a template's anchor weight that proposes a placement, and of its words that confirm it.
VOTES, MATCH = 0.5, 0.6


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    out, at, n = [], -1, len(phrase)
    for _ in range(words.count(phrase[0])):
        at = words.index(phrase[0], at + 1)
        if words[at : at + n] == phrase:
            out.append(at)
    return out


def aligned(template: list[bytes], region: list[bytes]) -> float:
    """The share of the template's words that stand in the region in the same order."""
    blocks = SequenceMatcher(None, template, region, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks) / len(template)


class Index:
    """Postings of the rarest words of each passage of each template, weighed by idf."""

    def __init__(self, idf: dict[bytes, float], templates=TEMPLATES, anchors: int = ANCHORS):
        self.idf, self.templates, self.postings, self.needed = idf, [], defaultdict(list), []
        for n, (label, text, phrases) in enumerate(templates):
            words = alnum_words(text.encode())
            self.templates.append((label, words, [(alnum_words(p.encode()), not p.startswith("!")) for p in phrases]))
            weight = 0.0
            for i in range(0, len(words), PASSAGE):
                passage = words[i : i + PASSAGE]
                for word in sorted(set(passage), key=lambda w: (-idf.get(w, 0.0), w))[:anchors]:
                    self.postings[word].append((n, i + passage.index(word)))
                    weight += idf.get(word, 0.0)
            self.needed.append(weight * VOTES)
        self.base = [(alnum_words(p.encode()), label) for p, label in BASE.items()]

    def confirmed(self, n: int, words: list[bytes], start: int) -> float:
        """The share of template n that stands near ``start``, 0 unless it's confirmed there."""
        _, own, phrases = self.templates[n]
        region = words[max(0, start) : start + len(own) + 2 * BAND]
        if any(bool(phrase_places(region, p)) != wanted for p, wanted in phrases):
            return 0.0
        share = aligned(own, region)
        return share if share >= MATCH else 0.0

    def placements(self, words: list[bytes]) -> dict[str, float]:
        """Label and best share of matching words of the templates found."""
        if self.postings.keys().isdisjoint(words):
            return {}
        votes: dict[tuple[int, int], set[int]] = defaultdict(set)
        for at, word in enumerate(words):
            for n, own in self.postings.get(word, ()):
                band = (at - own) // BAND
                votes[n, band].add(own)
                votes[n, band - 1].add(own)
        found: dict[str, float] = {}
        for (n, band), anchors in votes.items():
            label, own, _ = self.templates[n]
            if found.get(label, 0.0) < 1 and sum(self.idf.get(own[i], 0.0) for i in anchors) >= self.needed[n]:
                share = self.confirmed(n, words, band * BAND)
                if share:
                    found[label] = max(found.get(label, 0.0), share)
        return found

    def report(self, words: list[bytes]) -> tuple:
        places = {label: phrase_places(words, p) for p, label in self.base}
        every = sorted(at for found in places.values() for at in found)
        base = sorted(label for label, found in places.items() if found)
        found = self.placements(words)
        score = max([*found.values(), 0.5 if base else 0.0])
        return len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(base), ",".join(sorted({*base, *found})), score


def vocabulary(templates=TEMPLATES) -> frozenset[bytes]:
    return frozenset(w for _, text, _ in templates for w in alnum_words(text.encode()))


def document_frequency(docs: DataFrame, vocab: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Rows, and the number of rows that hold each word; bounded by the vocabulary."""

    def count(batches):
        total, seen = Counter(), 0
        for batch in batches:
            seen += batch.num_rows
            for text in byte_column(batch.column(0)):
                total.update(vocab.intersection(alnum_words(text.as_py())))
        total[b""] = seen
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    found = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r.word): r.n for r in found}
    return df.pop(b"", 0), df


REPORT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, anchors: int = ANCHORS) -> DataFrame:
    """doc_id and REPORT for each document."""
    vocab = vocabulary(templates)
    n, df = document_frequency(docs, vocab)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in vocab}
    index = docs.sparkSession.sparkContext.broadcast(Index(idf, templates, anchors))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def scan(batches):
        for batch in batches:
            rows = [index.value.report(alnum_words(text.as_py())) for text in byte_column(batch.column(1))]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {key}, {REPORT}")

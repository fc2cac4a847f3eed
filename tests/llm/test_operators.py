"""The operators on small fixtures: brute force, round trips and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from loomtext.llm import common, decontaminate, licenses, mixing, neardup, ngramlm, pii, quality, suffixes, toxicity, webp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long"


def documents(spark, rows):
    """rows: (doc_id, text); with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "own", 7) for i, t in rows], SCHEMA)


RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def text(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = text(120)
EDGE = [(1, None), (2, ""), (3, "..."), (4, "one two"), (4, "one two"), (5, LONG), (6, LONG), (7, LONG + " more words here"), (None, LONG), (8, text(3000))]

OPERATORS = {
    "near": lambda s, d: neardup.near_duplicates(d),
    "first": lambda s, d: neardup.keep_first(d),
    "repeats": lambda s, d: suffixes.repeated_passages(d),
    "mix": lambda s, d: mixing.mix_sources(d),
    "mixed": lambda s, d: mixing.mixed_documents(d),
    "bench": lambda s, d: decontaminate.contamination(d, s.createDataFrame([(1, LONG[:90]), (None, None)], "item_id long, text string")),
    "toxic": lambda s, d: toxicity.score_toxicity(d, s.createDataFrame([(5, 1), (8, 0), (2, None)], "doc_id long, toxic int")),
    "model": lambda s, d: ngramlm.score_texts(d),
    "licence": lambda s, d: licenses.scan_licenses(d),
    "pii": lambda s, d: pii.pii_report(d),
    "mask": lambda s, d: pii.mask_pii(d),
    "quality": lambda s, d: quality.score_quality(d, s.createDataFrame([(5, 1), (8, 0), (2, None)], "doc_id long, quality int")),
    "media": lambda s, d: webp.media_report(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    rows = OPERATORS[name](spark, documents(spark, EDGE)).collect()
    assert OPERATORS[name](spark, documents(spark, [])).collect() == []
    if name not in ("first", "repeats", "mixed"):
        assert len(rows) == len(EDGE)


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(1)
    base = [text(80, rng).split() for _ in range(12)]
    rows = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = "x%d" % rng.randrange(1000)
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(76)} for _, t in rows]
    label = list(range(90))
    for _ in range(90):
        for a in range(90):
            for b in range(a):
                if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert got == dict(enumerate(label))


@pytest.mark.parametrize("wide", [2, 1 << 20])
def test_wide_bands_by_brute_force(spark, wide):
    """Two bands of one coordinate: unlike texts share one, and some like pairs only one."""
    rng, rows = random.Random(8), []
    base = text(80, rng).split()
    for _ in range(60):
        words = list(base)
        for k in rng.sample(range(76), 5):
            words[k] = "x%d" % rng.randrange(10**6)
        rows += [" ".join(words), " ".join([*words[:78], "y%d" % rng.randrange(10**6), words[79]])]
    rng.shuffle(rows)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(76)} for t in rows]
    label = list(range(len(rows)))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(documents(spark, list(enumerate(rows))), bands=2, rows=1, wide=wide).collect()}
    assert got == dict(enumerate(label))


def test_sketches_lose_less_than_bands():
    k, odds = neardup.BANDS * neardup.ROWS, (1 - neardup.SIMILARITY) * 15 / 16
    lost = sum(math.comb(k, i) * odds**i * (1 - odds) ** (k - i) for i in range(neardup.allowed(k, neardup.SIMILARITY) + 1, k + 1))
    assert lost < (1 - neardup.SIMILARITY**neardup.ROWS) ** neardup.BANDS


def test_repeated_words_cost_no_more_darts(spark):
    rows = [(1, "the " * 60_000), (2, "the " * 50_000), (3, "a b " * 30_000), (4, "the " * 4), (5, "the " * 5)]
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(documents(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    elements = rng.integers(1, 2**63, 300).astype(np.uint64)
    x, y = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    rows = np.repeat([0, 1], 300)
    s = neardup.throw(rows, np.concatenate([elements, elements]), np.concatenate([x, y]), 2, 4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04


def test_repeats_by_brute_force(spark):
    rng = random.Random(3)
    passages = [text(n, rng) for n in (49, 50, 64, 200)]
    rows = [(i, " ".join([text(rng.randint(0, 60), rng), passages[i % 4], text(rng.randint(0, 60), rng)])) for i in range(40)]
    seen, expected = {}, {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    for i, t in rows:
        w = t.split()
        hit = {k + j for k in range(len(w) - 49) if len(seen[tuple(w[k : k + 50])]) > 1 for j in range(50)}
        if hit:
            expected[i] = hit
    got = {r.doc_id: {k for s in r.passages.split(",") for k in range(*map(int, s.split(":")))} for r in suffixes.repeated_passages(documents(spark, rows)).collect()}
    assert got == expected


def test_repeats_around_a_phrase_of_many_documents(spark):
    """Pairs that agree before (or around) a common phrase but go on differently."""
    rng = random.Random(4)
    phrase, rows = text(45, rng), []
    for pair in range(12):
        before, after = text(10, rng), text(3, rng)
        rows += [" ".join([text(20, rng), before, phrase, text(30, rng)]) for _ in range(2)]
        rows += [" ".join([text(20, rng), *before.split()[-3:], phrase, after, text(30, rng)]) for _ in range(2)]
    rows += [" ".join([text(30, rng), phrase, text(30, rng)]) for _ in range(60)]
    rng.shuffle(rows)
    seen, expected = {}, {}
    for i, t in enumerate(rows):
        w = t.split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    for i, t in enumerate(rows):
        w = t.split()
        hit = {k + j for k in range(len(w) - 49) if len(seen[tuple(w[k : k + 50])]) > 1 for j in range(50)}
        if hit:
            expected[i] = hit
    assert len(expected) == 48
    got = {r.doc_id: {k for s in r.passages.split(",") for k in range(*map(int, s.split(":")))} for r in suffixes.repeated_passages(documents(spark, list(enumerate(rows)))).collect()}
    assert got == expected


def test_slices_of_one_passage(spark):
    """Every document holds another slice of 50 words or more of the same passage."""
    rng = random.Random(21)
    passage, rows = text(200, rng).split(), []
    for _ in range(120):
        start = rng.randint(0, 150)
        rows.append(" ".join([text(rng.randint(0, 30), rng), *passage[start : rng.randint(start + 50, 200)], text(rng.randint(0, 30), rng)]))
    seen, expected = {}, {}
    for i, t in enumerate(rows):
        w = t.split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    for i, t in enumerate(rows):
        w = t.split()
        expected[i] = {k + j for k in range(len(w) - 49) if len(seen[tuple(w[k : k + 50])]) > 1 for j in range(50)}
    got = {r.doc_id: {k for s in r.passages.split(",") for k in range(*map(int, s.split(":")))} for r in suffixes.repeated_passages(documents(spark, list(enumerate(rows)))).collect()}
    assert got == {i: x for i, x in expected.items() if x}


def test_mix_meets_targets(spark):
    rows = mixing.mix_sources(documents(spark, [(i, text(20 + i % 30)) for i in range(300)])).collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    assert abs(sum({r.source: r.target for r in rows}.values()) - sum(r.size for r in rows)) < 1e-6


def test_wu_manber_finds_what_comparison_finds():
    rng = random.Random(4)
    words = [rng.choice([b"a", b"b", b"c"]) for _ in range(3000)]
    for length in (1, 2, 3, 5):
        patterns = {tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(length)) for _ in range(6)}
        search = decontaminate.WuManber(patterns)
        found = {(i, search.patterns[n]) for i, n in search.find(words)}
        assert found == {(i, tuple(words[i : i + length])) for i in range(len(words) - length + 1) if tuple(words[i : i + length]) in patterns}


def test_benchmark_in_chunks_gives_the_same(spark):
    docs = documents(spark, [(i, text(30) + " " + LONG[: 40 * (i % 4)]) for i in range(20)])
    bench = spark.createDataFrame([(i, text(15)) for i in range(30)] + [(99, LONG)], "item_id long, text string")
    one, many = ({r.doc_id: (r.n_hit, r.items_sha256) for r in decontaminate.contamination(docs, bench, chunk_bytes=n).collect()} for n in (1 << 20, 500))
    assert one == many and any(n for n, _ in one.values())


def test_spans():
    t = "mail a.b@x.org, call +49 (30) 1234567, card 4111 1111 1111 1111, host 10.0.0.1, IBAN DE89 3704 0044 0532 0130 00."
    assert [s[0] for s in pii.scored_spans(t)] == ["email", "ip", "card", "phone", "iban"]
    assert pii.mask(t).count("[") == 5
    assert pii.scored_spans("4111 1111 1111 1112 and 999.1.1.1") == []


def test_email_scan_equals_the_pattern():
    rng = random.Random(6)
    for _ in range(3000):
        t = "".join(rng.choice("ab.@-_ é9%") for _ in range(40))
        assert list(pii._email_spans(t)) == [m.span() for m in pii.EMAIL.finditer(t)]


def test_base_spans_equal_the_patterns(spark):
    """The report's counts and digest against the plain patterns on random texts."""
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("0123456789" * 2 + ".. -+()@aé😀") for _ in range(rng.randint(0, 120)))) for i in range(600)]
    rows += [(1000, "4111 1111-1111 1111 and 1.2.3.4.5.6.7.8 +1 (2) 3456789"), (1001, "1" * 20_000), (1002, None)]
    kinds = {"email": pii.EMAIL, "ip": pii.IP, "card": pii.CARD, "phone": pii.PHONE}

    def fits(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1]))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    got = {r.doc_id: r for r in pii.pii_report(documents(spark, rows)).collect()}
    for i, t in rows:
        spans = [(k, m.start(), m.end()) for k, p in kinds.items() for m in (p.finditer(t) if t and len(t) < 1000 else ()) if fits(k, m[0])]
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in spans) for k in kinds]
        assert got[i].base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()
    assert sum(r.n_card for r in got.values()) and sum(r.n_ip for r in got.values()) and sum(r.n_phone for r in got.values())


def test_base_phrases_by_brute_force(spark):
    rng = random.Random(10)
    vocabulary = ["MIT", "license", "apache", "general", "public", "x", "é"]
    rows = [(i, rng.choice([" ", ", ", "--"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(900, None)]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        assert (got[i].n_words, got[i].n_base) == (len(words), len(places))
        assert (got[i].first_word, got[i].last_word) == (min(starts, default=None), max(starts, default=None))
        assert got[i].base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))


def test_licence_labels(spark):
    rows = [(1, "Released under the MIT License. The MIT License!"), (2, "Licensed under the Apache License, Version 2.0."), (3, "licensed under CC BY-NC 4.0"), (4, text(200))]
    rows = rows + [(10 + i, text(50)) for i in range(30)]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 3, 6, "mit")
    assert got[2].labels == "apache,apache-2.0" and got[3].labels == "cc-by-nc" and got[4].score == 0


def test_classifiers_generalise(spark):
    rng = random.Random(7)
    rows = [(i, text(60, rng) + (" nasty" * 2 if i % 2 else "")) for i in range(1500)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1500)], "doc_id long, toxic int")
    held = [r for r in toxicity.score_toxicity(documents(spark, rows), labels).collect() if r.held_out]
    assert sum(r.predicted == r.doc_id % 2 for r in held) > 0.97 * len(held)
    rows = [(i, text(60, rng) if i % 2 else "### | ".join(text(60, rng).split())) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    held = [r for r in quality.score_quality(documents(spark, rows), labels).collect() if r.held_out]
    assert sum(r.predicted == r.doc_id % 2 for r in held) > 0.97 * len(held)


def test_word_hashes_depend_on_words_alone():
    a, b = b"x yy zzz " * 3, b"zzz " + b"q" * 700_000 + b" yy"
    one, two = (common.hashed_words(np.frombuffer(t, np.uint8), np.array([0, len(t)]), common.NONSPACE)[1] for t in (a, b))
    assert one[1] == two[2] and one[2] == two[0] and len(set(one.tolist())) == 3




def test_webp_payloads():
    for t in (b"", b"a" * 64, b"abc" * 5000, re.sub(r"\d", "", text(900)).encode(), b"\0" * 200):
        p = webp.payload_of(t)
        assert len(p) % 64 == 0 and p and webp.load(webp.store(p), len(p)) == p


def test_media_digests(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, text(300) + " é😀"), (5, text(300)), (6, None)]
    got = {r.doc_id: r for r in webp.media_report(documents(spark, rows)).collect()}
    for i, t in rows:
        data = (t or "").encode()
        padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(data), len(padded))
        assert got[i].payload_sha256 == hashlib.sha256(padded).hexdigest() and got[i].tail_crc32 == zlib.crc32(padded[-64:])
    assert got[1][1:] == got[2][1:] == got[6][1:]

"""The whole pipeline against a plain version of every stage but the learned one."""

import hashlib
import re
from collections import defaultdict

import corpus_pipeline
from loomtext.llm import pii, toxicity
from loomtext.llm.common import alnum_words, table

SF = "/root/testdata/sf0.001"


def first_of_each(docs):
    sets = {}
    for i, t in docs.items():
        w = alnum_words(t.encode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if b < a and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: t for i, t in docs.items() if root(i) == i}


def without_benchmark(docs, items):
    windows = defaultdict(set)
    for t in items:
        w = alnum_words(t.encode())
        n = min(10, len(w))
        windows[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n)

    def hit(t):
        w = alnum_words(t.encode())
        return any(tuple(w[k : k + n]) in found for n, found in windows.items() for k in range(len(w) - n + 1))

    return {i: t for i, t in docs.items() if not hit(t)}


def mixed(docs, source):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in docs.items()}
    names = sorted({source[i] for i in docs})
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    total = {s: sum(size[i] for i in docs if source[i] == s) for s in names}
    target, open_, left = {}, set(names), sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 3 * total[s]
            left -= target[s]
        open_ -= full
    taken = {}
    for s in names:
        budget = int(target[s] + 0.5)
        epochs = budget // total[s] if total[s] else 0
        rest = budget - epochs * total[s]
        for i in sorted((i for i in docs if source[i] == s), key=lambda i: hashlib.md5(f"mix{i}".encode()).hexdigest()):
            part = min(rest, size[i])
            rest -= part
            if epochs * size[i] + part:
                taken[i] = epochs * size[i] + part
    return taken


def run_plainly(documents, labels, benchmark, source):
    """Rows of the mix by id: words taken in all, from stages written out plainly."""
    bad = {r.doc_id for r in toxicity.score_toxicity(documents, labels).collect() if r.predicted}
    docs = {r.doc_id: r.text or "" for r in sorted(documents.collect(), key=lambda r: r.doc_id) if r.doc_id not in bad}
    docs = without_benchmark(first_of_each(docs), [r.text or "" for r in benchmark.collect()])
    docs = {i: pii.mask(t) for i, t in docs.items()}
    return docs, mixed(docs, source)


def check(got, docs, expected):
    total = defaultdict(int)
    for r in got:
        total[r.doc_id] += r.taken
        own = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        assert r.taken == len(own) and own == re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id])[: r.taken]
        assert docs[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert total == expected
    for i in total:
        assert sorted(r.epoch for r in got if r.doc_id == i) == list(range(1, 1 + sum(r.doc_id == i for r in got)))


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    documents = table(spark, SF, "documents")
    docs, expected = run_plainly(documents, table(spark, SF, "labels"), table(spark, SF, "benchmark"), {r.doc_id: r.source for r in documents.collect()})
    check(got, docs, expected)


LONG, VAST = " ".join(f"w{i}" for i in range(400)), " ".join(f"z{i}" for i in range(16_000))
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, key string, copy string, node long, taken string, _own long"


def tables(spark, folder, documents, benchmark=(), labels=()):
    spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", "c", 5, "t", 6) for i, t, s in documents], EXTRA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 0, x) for i, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


def test_edge_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, one id with two texts, very long texts,
    clashing names; without labels or benchmark."""
    rows = [(1, LONG, "a"), (2, LONG + " more", "a"), (3, None, "a"), (4, "", None), (5, "x y z", None), (5, "x y z", None), (6, "other words here", "a"), (6, "second text of six", "b")]
    rows += [(None, "lost id", "b"), (7, "... !", "b"), (8, "mail me at a.b@x.org now", "b"), (9, VAST, "c")]
    got = corpus_pipeline.run(spark, tables(spark, tmp_path / "t", rows)).collect()
    assert {r.doc_id for r in got} == {None, 1, 5, 6, 7, 8, 9}
    assert all(r.key == "k" and r.node == 5 and r._own == 6 for r in got)
    assert {r.text for r in got if r.doc_id == 8 and r.taken == 5} <= {"mail me at [EMAIL] now"}
    whole = {(r.doc_id, r.text) for r in got if r.epoch == 1}
    assert any(i == 9 and VAST.startswith(t) for i, t in whole)
    kept = {(1, 400, "a"), (5, 3, None), (6, 3, "a"), (6, 4, "b"), (None, 2, "b"), (7, 2, "b"), (8, 5, "b"), (9, 16_000, "c")}
    size = {s: sum(n for _, n, x in kept if x == s) for s in ("a", "b", "c", None)}
    assert all(0 < sum(r.taken for r in got if r.source == s) <= 3 * size[s] + 1 for s in size)
    assert abs(sum(r.taken for r in got) - sum(size.values())) <= len(size)


def test_every_row_a_copy_of_one(spark, tmp_path):
    rows = [(i, LONG, f"s{i % 2}") for i in range(300)]
    got = corpus_pipeline.run(spark, tables(spark, tmp_path / "t", rows, benchmark=[(1, "w1 w2"), (2, None)])).collect()
    assert got == []
    got = corpus_pipeline.run(spark, tables(spark, tmp_path / "u", rows)).collect()
    assert {r.doc_id for r in got} == {0} and sum(r.taken for r in got) == 400


def test_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, tables(spark, tmp_path / "t", []))
    assert out.collect() == [] and {"doc_id", "text", "epoch", "taken"} <= set(out.columns)


def test_stage_tables_go(spark, tmp_path):
    import os

    from loomtext.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    corpus_pipeline.run(spark, tables(spark, tmp_path / "t", [(1, LONG, "a"), (2, LONG + " y", "b")])).collect()
    left = {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before}
    assert not left & {"toxicity", "near-duplicates", "benchmark-decontamination", "personal-data", "signatures", "edges", "texts"}

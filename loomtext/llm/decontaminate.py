"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 4).

The alphabet is words. A block is two consecutive words; the shift table says how
far a search may move on when a block stands at the end of its position, so most
positions are never looked at. Where the shift is 0, the block's bucket names the
windows that end their shortest prefix in it and a direct comparison confirms them.

Windows that are shorter than the full width come from short items; each width is
searched with tables of its own, so that one short item doesn't shorten all jumps.
A benchmark of up to CHUNK_BYTES is searched in one pass that reports (or filters) rows
where they lie. A larger one is dealt into chunks: each is built, broadcast, searched by
a job of its own and released, and only the texts that it hits are written, under the
digest of the text, so a task that runs again writes the same.

Cases: null and empty texts have no words; an item without words has no window; a
null item_id counts as the id ''; items that share an id count once; repeated
documents are separate rows; a text of any length is searched whole, in memory
proportional to it; an empty benchmark finds nothing; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, byte_column, few, materialise, trim

WIDTH = 10
#: Bytes of benchmark text whose tables are held at once.
CHUNK_BYTES = 2 << 20


def windows(words: list[bytes], width: int) -> Iterator[tuple[bytes, ...]]:
    if 0 < len(words) < width:
        yield tuple(words)
    for i in range(len(words) - width + 1):
        yield tuple(words[i : i + width])


class WuManber:
    """Tables for patterns (tuples of words) of one common length."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]]):
        self.patterns = sorted(set(patterns))
        self.length = len(self.patterns[0])
        self.block = min(2, self.length)
        self.far = self.length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for n, words in enumerate(self.patterns):
            for end in range(self.block, self.length + 1):
                block = words[end - self.block : end] if self.block > 1 else words[end - 1]
                self.shift[block] = min(self.shift.get(block, self.far), self.length - end)
            self.bucket[block].append(n)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        get, far, length, last = self.shift.get, self.far, self.length, len(words)
        at = length - 1
        if self.block == 1:
            yield from ((i, n) for i, w in enumerate(words) if w in self.bucket for n in self.bucket[w])
            return
        while at < last:
            step = get((words[at - 1], words[at]), far)
            if step:
                at += step
                continue
            start = at - length + 1
            here = tuple(words[start : at + 1])
            for n in self.bucket.get(here[-2:], ()):
                if self.patterns[n] == here:
                    yield start, n
            at += 1


class Benchmark:
    """Search tables for a chunk of (item_id as text, text) rows."""

    def __init__(self, items: Iterable[tuple[str, bytes]], width: int = WIDTH):
        owners = defaultdict(set)
        for item, text in items:
            for window in windows(alnum_words(text), width):
                owners[window].add(item)
        by_length = defaultdict(list)
        for window in owners:
            by_length[len(window)].append(window)
        self.searches = [WuManber(found) for _, found in sorted(by_length.items())]
        self.owners = [[tuple(sorted(owners[p])) for p in s.patterns] for s in self.searches]

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Merged hit spans as start, end, start, end ... and the items found."""
        spans, items = [], set()
        for search, owners in zip(self.searches, self.owners, strict=True):
            for start, n in search.find(words):
                spans.append((start, start + search.length))
                items.update(owners[n])
        return merge(spans), items


def merge(spans: Iterable[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


_SPANS, _ITEMS = pa.list_(pa.int64()), pa.list_(pa.string())
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _chunks(bench: DataFrame, chunk_bytes: int) -> list[DataFrame]:
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    bench = bench.select(item, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    n = 1 + (bench.agg(F.sum(F.length("text"))).first()[0] or 0) // chunk_bytes
    return [bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == c) for c in range(n)] if n > 1 else [bench]


def _tables(bench: DataFrame, width: int):
    """The broadcast tables of a chunk, which has a bounded size."""
    return bench.sparkSession.sparkContext.broadcast(Benchmark(((r[0], bytes(r[1])) for r in bench.toLocalIterator()), width))


def _scanned(bench: Benchmark, texts: pa.Array):
    """Words, merged hit spans and items of each text."""
    for text in byte_column(texts):
        words = alnum_words(text.as_py())
        spans, items = bench.scan(words)
        yield len(words), spans, sorted(items)


def _hits(docs: DataFrame, chunks: list[DataFrame], width: int) -> DataFrame:
    """copy (the text's digest), spans, items of each distinct text that any chunk hits."""
    texts, found = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("copy"), "text"), None
    for chunk in chunks:
        tables = _tables(chunk, width)

        def scan(batches, tables=tables):
            for batch in batches:
                rows = [(c, s, i) for c, (_, s, i) in zip(batch.column(0), _scanned(tables.value, batch.column(1)), strict=True) if s]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), _SPANS, _ITEMS))]
                yield pa.RecordBatch.from_arrays(columns, ["copy", "spans", "items"])

        part = materialise(texts.mapInArrow(scan, "copy string, spans array<long>, items array<string>").dropDuplicates(["copy"]), "hits")
        tables.destroy()
        found = part if found is None else found.unionByName(part)
    each = found.groupBy("copy").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))  # one row a chunk

    def join(batches):
        for batch in batches:
            spans = [merge(zip(x[::2], x[1::2], strict=True)) for x in batch.column(1).to_pylist()]
            items = [sorted(set(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS), pa.array(items, _ITEMS)], ["copy", "spans", "items"])

    return materialise(each.mapInArrow(join, "copy string, spans array<long>, items array<string>"), "hits")


def contamination(docs: DataFrame, bench: DataFrame, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged hit
    spans, as start, end, start, end ... in words) for each document."""
    chunks = _chunks(bench, chunk_bytes)
    if len(chunks) == 1:
        tables = _tables(chunks[0], width)

        def scan(batches):
            for batch in batches:
                rows = list(_scanned(tables.value, batch.column(1)))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), _SPANS, _ITEMS))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "spans", "items"])

        key = docs.schema["doc_id"].dataType.simpleString()
        found = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {key}, n_words long, spans array<long>, items array<string>")
    else:
        text = F.coalesce("text", F.lit(""))
        rows = docs.select("doc_id", F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"), F.md5(text).alias("copy"))
        none = [F.coalesce(name, F.array().cast(kind)).alias(name) for name, kind in (("spans", "array<long>"), ("items", "array<string>"))]
        found = rows.join(few(_hits(docs, chunks, width)), "copy", "left").select("doc_id", "n_words", *none)
    ends = F.filter("spans", lambda _, i: i % 2 == 1)
    starts = F.filter("spans", lambda _, i: i % 2 == 0)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x)
    return found.select(
        "doc_id",
        "n_words",
        (total(ends) - total(starts)).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def clean_documents(docs: DataFrame, bench: DataFrame, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    chunks, at = _chunks(bench, chunk_bytes), docs.columns.index("text")
    if len(chunks) > 1:
        hit = few(_hits(docs, chunks, width).select(F.col("copy").alias("__hit_copy")))
        return docs.join(hit, F.md5(F.coalesce("text", F.lit(""))) == F.col("__hit_copy"), "left_anti")
    tables = _tables(chunks[0], width)

    def scan(batches):
        for batch in batches:
            yield batch.filter(pa.array([not spans for _, spans, _ in _scanned(tables.value, batch.column(at))], pa.bool_()))
        trim()

    return docs.mapInArrow(scan, docs.schema)


ORACLE = r"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS width, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS pat
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT width FROM p),
s AS (SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS pat
      FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, g WHERE len(w) >= width)),
h AS (SELECT s.doc_id, s.i, s.width, p.item FROM s JOIN p USING (width, pat)),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS k FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

"""Near-duplicate documents by DartMinHash (operator 1).

A document is a set of five-word shingles with weights. The plane of weight and rank
of every element is cut into unit squares; each holds a Poisson number of darts that
depend on the element and the square alone. A dart lands on one signature coordinate,
and the earliest dart under the document's weights keeps it. Only ranks up to t over
the total weight are thrown, with t near k log k, so a signature of k coordinates
costs about k log k darts however long the text is. If a coordinate stays empty, the
rank bound doubles for that document.

ROWS coordinates make a band. Documents that share a band are compared with the
band's leader by exact set similarity, so a band of n documents costs n comparisons.
Where a band still holds more than one class, its members are compared with a second
leader, then across the classes that remain, in wide bands block by block. Pairs whose
sketches (four bits of each coordinate) differ by DEVIATIONS standard deviations more
than the similarity allows aren't compared.
Links pass through connected components.

Weights are 1 by default, since the contract's similarity is that of shingle sets
(then repeats change nothing); weights='count' signs the multiset instead.

Cases: texts without words (null, empty, punctuation) link to nothing; fewer than
five words are one shingle; equal texts are one node, whatever their number; rows
that share an id but not their text are one node for linking; a row with a null id
gets a null class; a text of any length has one signature of the same size; ids of
other whole-number types are cast to long; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, few, hashed_words, join_keys, materialise, mix, remove, row_chunks, trim
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 48, 7
#: Bands with more members are compared across classes in pairs of blocks of about this size.
WIDE = 1024
#: A pair exactly at the threshold is left out once in 124,000 such pairs (the bands lose one in 80,000).
DEVIATIONS = 4.5

_CELL, _DART, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
_POISSON = np.array([int(min(1.0, p) * (2**32 - 1)) for p in np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, i + 1), initial=1.0) for i in range(14)])], U64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle; a shorter row's words are one shingle."""
    rows, words = hashed_words(data, offsets, ALNUM)
    if not len(rows):
        return rows, words
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    take = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    own = np.repeat(np.arange(len(counts)), take)
    at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + first[own]
    length = np.minimum(counts, size)[own]
    total = np.zeros(len(at), U64)
    for i in range(size):
        inside = i < length
        total[inside] = mix(total[inside] * _STEP + words[at[inside] + i])
    return own, mix(total + length.astype(U64))


def weighted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, element) with their counts."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])) if len(rows) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows))).astype(float)


def throw(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n, k): the rank of each coordinate's earliest dart as a 64-bit
    fixed-point number, which names the dart; rows without elements keep the maximum."""
    empty = np.iinfo(U64).max
    best = np.full((n, k), empty, U64)
    total = np.bincount(rows, weights, n)
    bound = np.where(total > 0, k * (np.log(k) + 3) / np.maximum(total, 1e-12), 0.0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        here = np.isin(rows, todo)
        r, e, w = rows[here], elements[here], weights[here]
        high, wide = np.ceil(bound[r]).astype(np.int64), np.ceil(w).astype(np.int64)
        cells = high * wide
        own = np.repeat(np.arange(len(r)), cells)
        at = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        rank, level = at // wide[own], at % wide[own]
        seed = mix(e[own] ^ mix((rank.astype(U64) + U64(1)) * _CELL + (level.astype(U64) << U64(32))))
        darts = np.searchsorted(_POISSON, seed >> U64(32), side="left")
        cell = np.repeat(np.arange(len(own)), darts)
        turn = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(seed[cell] + (turn.astype(U64) + U64(1)) * _DART)
        place = mix(dart ^ _STEP)
        share = (place & U64(0xFFFFFFFF)).astype(float) / 2**32  # height within the cell's weight
        fixed = (rank[cell].astype(U64) << U64(40)) | (dart >> U64(24))
        row = r[own][cell]
        under = (level[cell] + share < w[own][cell]) & (rank[cell] + (dart >> U64(24)).astype(float) / 2**40 < bound[row])
        spot = row * k + ((place >> U64(32)) * U64(k) >> U64(32)).astype(np.int64)
        np.minimum.at(best.reshape(-1), spot[under], fixed[under])
        todo = todo[(best[todo] == empty).any(1)]
        bound[todo] *= 2
    return best


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) keys that name the band and its coordinates."""
    keys = np.repeat(mix(np.arange(1, bands + 1, dtype=U64))[None, :], len(signature), 0)
    parts = signature.reshape(len(signature), bands, rows)
    for i in range(rows):
        keys = mix(keys * _STEP + parts[:, :, i])
    return keys


def sketches(signature: np.ndarray) -> np.ndarray:
    """(n, 4 * words): the lowest four bits of every coordinate, as four bit planes."""
    n, k = signature.shape
    planes = np.zeros((n, 4, -(-k // 64) * 64), np.uint8)
    planes[:, :, :k] = signature[:, None, :] >> np.arange(4, dtype=U64)[None, :, None] & U64(1)
    return np.packbits(planes.reshape(n, -1), axis=1).view(np.int64)


def allowed(k: int, least: float) -> int:
    """In how many of k coordinates the sketches of a pair to be compared may differ."""
    odds = (1 - least) * 15 / 16
    return int(k * odds + DEVIATIONS * (k * odds * (1 - odds)) ** 0.5)


def alike(x: str, y: str, k: int, least: float) -> F.Column:
    """Whether two sketches differ in no more coordinates than the similarity allows."""
    words = -(-k // 64)
    word = lambda i: " | ".join(f"({x}[{p * words + i}] ^ {y}[{p * words + i}])" for p in range(4))
    return F.expr(" + ".join(f"bit_count({word(i)})" for i in range(words))) <= allowed(k, least)


def signed(docs: DataFrame, bands: int, rows: int, weights: str = "set") -> DataFrame:
    """doc_id, copy (a digest of the text), bands (null for texts without words), sketch."""

    def scan(batches):
        for batch in batches:
            keys, bits = [], []
            for i, j, data, offsets in row_chunks(batch.column(2), max_rows=128):
                own, found = shingles(data, offsets)
                own, found, weight = weighted(own, found)
                weight = weight if weights == "count" else np.ones(len(own))
                signature = throw(own, found, weight, j - i, bands * rows)
                bands_of = band_keys(signature, bands, rows).view(np.int64)
                bits += list(sketches(signature))
                full = np.bincount(own, minlength=j - i) > 0
                keys += [row if ok else None for row, ok in zip(bands_of, full, strict=True)]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, longs), pa.array(bits, longs)], ["doc_id", "copy", "bands", "sketch"])
        trim()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("copy"), "text")
    return texts.mapInArrow(scan, "doc_id long, copy string, bands array<long>, sketch array<long>")


def similar_pairs(pairs: DataFrame, texts: DataFrame, least: float, weights: str = "set") -> DataFrame:
    """Those (a, b) whose shingles' Jaccard similarity is ``least`` or more."""

    def sets(col):
        out = []
        for i, j, data, offsets in row_chunks(col):
            own, found, count = weighted(*shingles(data, offsets))
            cut = np.searchsorted(own, np.arange(j - i + 1))
            out += [(found[x:y], count[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def similarity(x, y):
        common, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
        if weights == "count":
            both = np.minimum(x[1][i], y[1][j]).sum()
            return both / max(x[1].sum() + y[1].sum() - both, 1)
        return len(common) / max(len(x[0]) + len(y[0]) - len(common), 1)

    def scan(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # no more shingle sets at once
                part = batch.slice(i, 256)
                good = [similarity(x, y) >= least for x, y in zip(sets(part.column(2)), sets(part.column(3)), strict=True)]
                mask = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])
        trim()

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(scan, "a long, b long")


def _pairs(a: str, b: str, of: DataFrame) -> DataFrame:
    return of.where(f"{a} <> {b}").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _mixed(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of bands that still hold several classes, with their class and the
    number of the band's members."""
    found = components(links)
    named = materialise(members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("class")), "named")
    several = named.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("node").alias("second"), F.count(F.lit(1)).alias("n"))
    several = materialise(several.where("low <> high").select("key", "second", "n"), "several")
    mixed = materialise(join_keys(named, several, "key", "n"), "mixed")
    for used in (found, named, several):
        remove(used)
    return mixed


def _across(bins: DataFrame, nodes: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs of different classes in a bin whose sketches are alike, each in the first
    bin that it shares."""
    own = bins.groupBy("node").agg(F.collect_set("key").alias("keys"))  # no more than there are bands
    full = bins.join(nodes.select("node", "sketch").join(own, "node"), "node")
    x, y = (full.select("key", F.col("node").alias(n), F.col("class").alias(f"c{n}"), F.col("sketch").alias(f"s{n}"), F.col("keys").alias(f"k{n}")) for n in "xy")
    once = "array_min(array_intersect(kx, ky)) = key"
    return _pairs("x", "y", x.join(y, "key").where(F.col("cx") < F.col("cy")).where(alike("sx", "sy", k, least)).where(once))


def _blocks(bins: DataFrame, nodes: DataFrame, k: int, least: float, wide: int) -> DataFrame:
    """The same for bins (with their size n) of any width: members are dealt to blocks of
    about ``wide``, and each two blocks are compared in a group of their own."""
    most = allowed(k, least)

    def near(x: pd.DataFrame, y: pd.DataFrame):
        if not len(x) or not len(y):
            return
        sx, sy = (np.stack(s["sketch"].to_numpy()).astype(np.int64).view(U64).reshape(len(s), 4, -1) for s in (x, y))
        for i in range(0, len(x), 64):
            differ = np.zeros((len(sx[i : i + 64]), len(y), sx.shape[2]), U64)
            for plane in range(4):
                differ |= sx[i : i + 64, None, plane] ^ sy[None, :, plane]
            good = (np.bitwise_count(differ).sum(2, dtype=np.int64) <= most) & (x["class"].to_numpy()[i : i + 64, None] != y["class"].to_numpy()[None])
            a, b = np.nonzero(good)
            yield x["node"].to_numpy()[a + i], y["node"].to_numpy()[b]

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        main = rows["class"] == rows["class"].mode().iloc[0]  # its members needn't be compared with each other
        x, y = (rows["own"] == rows[side].iloc[0] for side in ("low", "high"))
        found = [*near(rows[x & ~main], rows[y]), *near(rows[x & main], rows[y & ~main])]
        a, b = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    count = F.ceil(F.col("n") / wide).cast("int")
    dealt = bins.join(nodes.select("node", "sketch"), "node").withColumn("own", F.pmod(F.xxhash64("node", "key"), count).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    sides = (F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return spread.select("key", *sides, "own", "node", "class", "sketch").groupBy("key", "low", "high").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weights: str = "set", wide: int = WIDE) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and class_size for each document."""
    every = materialise(signed(docs, bands, rows, weights), "signatures")
    plain = materialise(every.select("doc_id", "copy", F.col("bands").isNotNull().alias("full")), "rows")
    copies = materialise(plain.where("full AND doc_id IS NOT NULL").groupBy("copy").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "copies")
    signatures = every.where("bands IS NOT NULL").select("copy", F.col("doc_id").alias("node"), "bands", "sketch")
    nodes = materialise(signatures.join(copies.select("copy", "node"), ["copy", "node"]).select("node", "bands", "sketch").dropDuplicates(["node"]), "nodes")
    remove(every)
    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = materialise(banded.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    members = materialise(join_keys(banded, shared, "key", "n").select("node", "key", "leader"), "bands")
    remove(shared)
    wanted = materialise(members.select(F.col("node").alias("wanted")).distinct(), "wanted")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("node"), "text")
    texts = materialise(texts.join(few(wanted), F.col("node") == F.col("wanted"), "left_semi"), "texts")
    first = materialise(_pairs("node", "leader", members), "pairs")
    links = materialise(similar_pairs(first, texts, least, weights), "links")

    mixed = _mixed(members, links)
    second = materialise(_pairs("node", "second", mixed).join(first, ["a", "b"], "left_anti"), "pairs")
    more = materialise(similar_pairs(second, texts, least, weights), "links")
    remove(mixed)

    mixed = _mixed(members.select("key", "node"), links.union(more))
    narrow = mixed.where(F.col("n") <= wide).select("key", "node", "class")
    broad = mixed.where(F.col("n") > wide).select("key", "node", "class", "n")
    across = _across(narrow, nodes, bands * rows, least).union(_blocks(broad, nodes, bands * rows, least, wide)).distinct()
    rest = materialise(across.join(first.union(second), ["a", "b"], "left_anti"), "pairs")
    last = materialise(similar_pairs(rest, texts, least, weights), "links")

    found = components(links.union(more).union(last))
    classes = materialise(copies.join(found, "node", "left").select("copy", "n", F.coalesce("component", "node").alias("class_id")), "classes")
    for used in (copies, nodes, members, wanted, texts, first, second, mixed, rest, links, more, last, found):
        remove(used)
    known = F.col("full") & F.col("doc_id").isNotNull()
    alone = plain.where(~known).select("doc_id", F.col("doc_id").alias("class_id"))
    named = materialise(join_keys(plain.where(known).select("copy", "doc_id"), classes, "copy", "n").select("doc_id", "class_id").union(alone), "classes")
    sizes = materialise(named.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")), "sizes")
    for used in (plain, classes):
        remove(used)
    nulls = named.where("class_id IS NULL")
    both = join_keys(named, sizes.where("class_id IS NOT NULL"), "class_id", "class_size").select("doc_id", "class_id", "class_size")
    return both.unionByName(nulls.crossJoin(F.broadcast(sizes.where("class_id IS NULL").select("class_size"))))  # one row at most


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """One document of each class (that of the least id), with its own columns.

    Rows with a null id and texts without words all stay; of rows equal in every column one stays.
    """
    found = near_duplicates(docs.select("doc_id", "text"), **how)
    extra = materialise(found.where("doc_id <> class_id").select(F.col("doc_id").alias("__extra_id")).distinct(), "extra")
    twice = materialise(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__twice_id")), "twice")
    id_ = F.col("doc_id").cast("long")
    kept = docs.join(few(extra), id_ == F.col("__extra_id"), "left_anti")
    if twice.isEmpty():
        return kept
    again = few(twice)
    return kept.join(again, id_ == F.col("__twice_id"), "left_anti").unionByName(kept.join(again, id_ == F.col("__twice_id"), "left_semi").dropDuplicates())

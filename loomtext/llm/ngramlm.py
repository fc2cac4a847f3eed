"""Interpolated modified Kneser-Ney trigram model, counted in Spark (operator 6).

Tokens are counted by 64-bit hash over all training texts; a token's place in the sorted
hash array is its id. Trigrams leave each task pre-aggregated and are dealt by their middle
word: the contexts (u, v), the bigrams (v, w) with their numbers of distinct u, and what v
is followed by all meet in one bucket, so one shuffle yields every order. A middle word
that would fill more than half a bucket is dealt by the whole trigram into as many parts
as its count asks for; the counts that its parts hold of a context or a bigram are summed
afterwards. How many parts a word has follows from its count in the mapped vocabulary, so
nothing is listed on the driver.

All trigrams, bigrams and words are stored, those seen once too. The model is a folder of
sorted hash arrays, one file a bucket, which workers memory-map to score whole texts: the
files of a bucket hold the hashes of its contexts, each context's followers (sorted ids and
counts) and the hashes of its bigrams. A text begins with two start marks. The lowest order
interpolates with the uniform distribution over the vocabulary and one unknown token.

Cases: null and empty texts are the end token alone; without training rows every
probability is 1 (scores 0); repeated rows count as often as they stand there; very long
texts are scored as a whole, a word of any length is one token; rows with a null id are
training rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NONSPACE, U64, delete, held_out, hashed_words, materialise, mix, remove, row_chunks, shared_path
from .hasharrays import HashArrays, map_file, save_file, write_arrays

END = U64(0x00E9D00000E9D000)
#: Ids below the vocabulary's: a token that training hasn't seen, and the start mark.
UNKNOWN, START, FIRST = 0, 1, 2
#: Tokens for each bucket, tokens that a task holds before it sends them on, bytes scored at once.
BUCKET_TOKENS, FLUSH, CHUNK = 1_000_000, 1_000_000, 4 << 20
_PAIR = U64(0x9FB21C651E98DF25)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each token; every row ends with END."""
    rows, words = hashed_words(data, offsets, NONSPACE)
    n = len(offsets) - 1
    out = np.full(len(words) + n, END, U64)
    out[np.arange(len(words)) + rows] = words
    own = np.empty(len(out), np.int64)
    own[np.arange(len(words)) + rows] = rows
    own[np.cumsum(np.bincount(rows, minlength=n)) + np.arange(n)] = np.arange(n)
    return own, out


def before(begins: np.ndarray, values: np.ndarray, start) -> np.ndarray:
    """The value before each one; ``start`` where a text begins."""
    return np.where(begins, start, np.append(values[:0].dtype.type(start), values[:-1])).astype(values.dtype)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two ids (or of a hash and an id)."""
    return mix(mix(a * _PAIR + b) * _PAIR + b)


def parts_of(count: np.ndarray, size: int) -> np.ndarray:
    """Into how many parts a middle word of this count is dealt."""
    return np.maximum(1, -(-2 * count // size))


def bucket_of(u: np.ndarray, v: np.ndarray, w: np.ndarray, parts: np.ndarray, buckets: int) -> np.ndarray:
    part = np.where(parts > 1, (pair(u, w) >> U64(32)).astype(np.int64) % parts, 0)
    return ((mix(v * _PAIR + part.astype(U64)) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _flushed(batches, column: int, flush):
    """Feed ``flush`` with (begins, token hashes) of about FLUSH tokens at a time."""
    held, size = [], 0
    for batch in batches:
        for _, _, data, offsets in row_chunks(batch.column(column)):
            own, found = tokens(data, offsets)
            held.append((np.append(True, own[1:] != own[:-1]), found))
            size += len(own)
            if size >= FLUSH:
                yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))


def count_tokens(docs: DataFrame) -> DataFrame:
    """(key, c): how often each token stands in the texts."""

    def flush(_, found):
        keys, c = np.unique(found, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c.astype(np.int64))], ["key", "c"])

    return docs.select("text").mapInArrow(lambda batches: _flushed(batches, 0, flush), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


# --- trigrams on their way to their bucket ---------------------------------


def _pack(columns: list[np.ndarray]) -> bytes:
    """The columns' bytes, plane by plane, compressed."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(block: bytes, n: int, types: list) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(pa.decompress(block, n * sum(np.dtype(t).itemsize for t in types), "zstd"), np.uint8), 0, []
    for t in types:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(t))
        at += n * size
    return out


def _types(distinct: int) -> list:
    ids = "<u4" if distinct + FIRST < 2**32 else "<u8"
    return [ids, ids, ids, "<u4"]


def trigram_blocks(docs: DataFrame, vocabulary: HashArrays, starts: int, distinct: int, buckets: int, size: int) -> DataFrame:
    """Pre-aggregated trigrams as blocks (bucket, hot, n, block) of columns v, u, w, c;
    hot blocks hold the middle words that are dealt in parts."""
    types = _types(distinct)

    def flush(begins, found):
        unique, inverse = np.unique(found, return_inverse=True)
        w = (vocabulary.rank(unique) + FIRST)[inverse].astype(U64)  # all are known
        parts = parts_of(vocabulary.find(unique)[0], size)[inverse]
        v, parts = before(begins, w, START), before(begins, parts, parts_of(np.int64(starts), size))
        u = before(begins, v, START)
        _, first, c = np.unique(pair(pair(u, v), w), return_index=True, return_counts=True)
        u, v, w, parts = u[first], v[first], w[first], parts[first]
        place = bucket_of(u, v, w, parts, buckets) * 2 + (parts > 1)
        order = np.lexsort((u, v, place))
        columns, place = [x[order].astype(t) for x, t in zip((v, u, w, c), types, strict=True)], place[order]
        at = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        ends = np.append(at[1:], len(place))
        blocks = [_pack([x[a:b] for x in columns]) for a, b in zip(at, ends, strict=True)]
        fields = [pa.array((place[at] // 2).astype(np.int32)), pa.array(place[at] % 2 == 1), pa.array((ends - at).astype(np.int32)), pa.array(blocks, pa.binary())]
        return pa.RecordBatch.from_arrays(fields, ["bucket", "hot", "n", "block"])

    return docs.select("text").mapInArrow(lambda batches: _flushed(batches, 0, flush), "bucket int, hot boolean, n int, block binary")


# --- one bucket's file -----------------------------------------------------


def _small(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in a byte each; 255 refers to the two lists of larger ones."""
    big = np.flatnonzero(c >= 255)
    return np.minimum(c, 255).astype(np.uint8), big.astype(np.uint32), c[big].astype(U64)


def _whole(small: np.ndarray, at: np.ndarray, big_at: np.ndarray, big: np.ndarray) -> np.ndarray:
    c = small[at].astype(np.int64)
    large = np.flatnonzero(c == 255)
    c[large] = big[np.searchsorted(big_at, at[large])]
    return c


class Bucket:
    """Sorted arrays of one bucket: context hashes, where the followers of each begin,
    the followers' ids and counts, bigram hashes and their numbers of left neighbours."""

    NAMES = ("contexts", "bigrams", "big", "big_lefts", "begin", "ids", "big_at", "big_lefts_at", "counts", "lefts")
    TYPES = (U64, U64, U64, U64, np.uint32, None, np.uint32, np.uint32, np.uint8, np.uint8)

    def __init__(self, raw: np.ndarray):
        head = raw[: 8 * (len(self.NAMES) + 1)].view(U64).astype(np.int64)
        at = 8 * len(head)
        for name, kind, n in zip(self.NAMES, self.TYPES, head[1:].tolist(), strict=True):
            kind = np.dtype(kind or f"<u{head[0]}")
            setattr(self, name, raw[at : at + n * kind.itemsize].view(kind))
            at += n * kind.itemsize

    @classmethod
    def pack(cls, id_type, contexts, begin, ids, counts, bigrams, lefts) -> bytes:
        counts, big_at, big = _small(counts)
        lefts, big_lefts_at, big_lefts = _small(lefts)
        own = locals()
        arrays = [own[name].astype(kind or id_type) for name, kind in zip(cls.NAMES, cls.TYPES, strict=True)]
        return b"".join([np.array([np.dtype(id_type).itemsize, *map(len, arrays)], U64).tobytes(), *[x.tobytes() for x in arrays]])

    def find(self, contexts: np.ndarray, words: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each trigram's count, and its context's total and what discounts take from it;
        contexts come sorted, ``cut`` is the discount of counts 0 to 3 and more."""
        new = np.append(True, contexts[1:] != contexts[:-1])
        keys, own = contexts[new], np.cumsum(new) - 1
        at = np.searchsorted(self.contexts, keys)
        there = at < len(self.contexts)
        there[there] = self.contexts[at[there]] == keys[there]
        at = np.where(there, at, 0)
        low = np.where(there, self.begin[at], 0).astype(np.int64)
        size = np.where(there, self.begin[at + 1] - low, 0).astype(np.int64)
        which = np.repeat(np.arange(len(keys)), size)
        flat = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]
        c = _whole(self.counts, flat, self.big_at, self.big)
        total, mass = (np.bincount(which, x, len(keys)) for x in (c, cut[np.minimum(c, 3)]))
        follower = which.astype(U64) << U64(40) | self.ids[flat]  # sorted: by context, then by id
        wanted = own.astype(U64) << U64(40) | words
        spot = np.minimum(np.searchsorted(follower, wanted), max(len(follower) - 1, 0))
        found = np.where(follower[spot] == wanted, c[spot], 0) if len(follower) else np.zeros(len(words), np.int64)
        return found, total[own], mass[own]

    def lefts_of(self, bigrams: np.ndarray) -> np.ndarray:
        keys, own = np.unique(bigrams, return_inverse=True)  # sorted keys are found faster
        at = np.searchsorted(self.bigrams, keys)
        there = at < len(self.bigrams)
        there[there] = self.bigrams[at[there]] == keys[there]
        out = np.zeros(len(keys), np.int64)
        out[there] = _whole(self.lefts, at[there], self.big_lefts_at, self.big_lefts)
        return out[own]


REDUCED = "kind int, key long, c long, n1 long, n2 long, n3 long"
#: Rows of the reduced table: counts of trigrams' counts, of bigrams' left neighbours; what
#: follows a middle word; contexts of a word; and the parts of hot contexts and bigrams.
SEEN3, SEEN2, MIDDLE, CONTINUED, CONTEXT, BIGRAM = range(6)


def _merge(folder: str, types: list):
    def merge(blocks: pd.DataFrame) -> pd.DataFrame:
        columns = [_unpack(b, n, types) for b, n in zip(blocks["block"], blocks["n"], strict=True)]
        hot = np.repeat(blocks["hot"].to_numpy(), blocks["n"].to_numpy())
        v, u, w, c = (np.concatenate(x) for x in zip(*columns, strict=True))
        context = pair(u.astype(U64), v.astype(U64))
        order = np.lexsort((w, context))
        v, w, c, hot, context = v[order], w[order], c[order], hot[order], context[order]
        first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (w[1:] != w[:-1])))
        c = np.add.reduceat(c.astype(np.int64), first)
        v, w, hot, context = v[first].astype(U64), w[first].astype(U64), hot[first], context[first]
        begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        bigrams, at, lefts = np.unique(pair(v, w), return_index=True, return_counts=True)
        left, right, warm = v[at], w[at], hot[at]
        cold = ~warm
        save_file(f"{folder}/{int(blocks['bucket'].iloc[0])}.bin", Bucket.pack(types[0], context[begin], np.append(begin, len(c)), w, c, bigrams[cold], lefts[cold]))

        once = lambda x: [(x == 1), (x == 2), (x >= 3)]
        seen = lambda x: np.bincount(np.minimum(x, 5), minlength=6)[1:5]
        key = lambda x: mix(x).view(np.int64)
        mids, own = np.unique(left[cold], return_inverse=True)
        middle = [np.bincount(own, x, len(mids)).astype(np.int64) for x in (lefts[cold], *once(lefts[cold]))]
        nexts, n = np.unique(right[cold], return_counts=True)
        open_ = hot[begin]
        stats = [np.add.reduceat(x.astype(np.int64), begin)[open_] for x in (c, *once(c))]
        rows = [
            (SEEN3, np.arange(1, 5), seen(c), 0, 0, 0),
            (SEEN2, np.arange(1, 5), seen(lefts[cold]), 0, 0, 0),
            (MIDDLE, key(mids), *middle),
            (CONTINUED, key(nexts), n, 0, 0, 0),
            (CONTEXT, context[begin][open_].view(np.int64), *stats),
            (BIGRAM, bigrams[warm].view(np.int64), lefts[warm], key(left[warm]), key(right[warm]), 0),
        ]
        sizes = [len(r[1]) for r in rows]
        column = lambda i: np.concatenate([np.broadcast_to(np.asarray(r[i], np.int64), k) for r, k in zip(rows, sizes, strict=True)])
        return pd.DataFrame({"kind": np.repeat(np.arange(6, dtype=np.int32), sizes), **{k: column(i) for i, k in enumerate(("key", "c", "n1", "n2", "n3"), 1)}}, copy=False)

    return merge


def discounts(seen: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts from the counts of counts, within [0, count]."""
    n1, n2, n3, n4 = (float(seen.get(i, 0)) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ratio = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a else y
    return ratio(1, n1, n2), ratio(2, n2, n3), ratio(3, n3, n4)


def _less(c: np.ndarray, cut: tuple[float, float, float]) -> np.ndarray:
    """Counts after their discount."""
    return c - np.array([0.0, *cut])[np.minimum(c, 3).astype(np.int64)]


# --- the model -------------------------------------------------------------


class Model:
    """Folders of sorted hash arrays and the constants that tie them together."""

    #: Bucket files that a worker keeps mapped.
    OPEN = 512

    def __init__(self, **fields):
        self.__dict__.update(fields, open=OrderedDict())

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "open"}

    def __setstate__(self, state):
        self.__init__(**state)

    def remove(self, spark) -> None:
        """Delete the model's files."""
        for folder in (self.folder, self.vocabulary.folder, self.words.folder, self.hot_contexts.folder, self.hot_bigrams.folder):
            delete(spark, folder)

    def bucket(self, n: int) -> Bucket | None:
        if n not in self.open:
            raw = map_file(f"{self.folder}/{n}.bin")
            self.open[n] = None if raw is None else Bucket(raw)
            if len(self.open) > self.OPEN:
                self.open.popitem(last=False)
        return self.open[n]

    def score(self, own: np.ndarray, found: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and model score of each of n rows."""
        distinct, inverse = np.unique(found, return_inverse=True)
        ids, c = self.vocabulary.rank(distinct) + FIRST, self.vocabulary.find(distinct)[0]
        ids = np.where(c > 0, ids, UNKNOWN)
        p1, total, gamma = self._words(ids)
        base = np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))
        begins = np.append(True, own[1:] != own[:-1])
        _, start_total, start_gamma = (x[0] for x in self._words(np.array([START])))
        w, parts = ids[inverse].astype(U64), parts_of(c, self.size)[inverse]
        v, parts = before(begins, w, START), before(begins, parts, parts_of(np.int64(self.starts), self.size))
        u = before(begins, v, START)
        total, gamma = before(begins, total[inverse], start_total), before(begins, gamma[inverse], start_gamma)

        count, held, mass, lefts = self._counts(u, v, w, parts)
        p = p1[inverse]
        p = np.where(total > 0, _less(lefts, self.cut2) / np.maximum(total, 1) + gamma * p, p)
        p = np.where(held > 0, (_less(count, self.cut3) + mass * p) / np.maximum(held, 1), p)
        add = lambda x: np.bincount(own, x, n)
        return add(np.ones(len(own))).astype(np.int64), add(c[inverse] > 0).astype(np.int64), add(base[inverse]), add(np.log10(p))

    def _words(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Lowest-order probability of each word, and what its followers sum to and leave over."""
        keys = mix(ids.astype(U64))
        order = np.argsort(keys)
        columns = self.words.find(keys[order])
        out = [np.empty_like(x) for x in columns]
        for to, x in zip(out, columns, strict=True):
            to[order] = x
        k, total, mass = out
        return _less(k, self.cut1) / max(self.types, 1) + self.unknown, total, mass / np.maximum(total, 1)

    def _counts(self, u, v, w, parts):
        """Of each trigram: its count, its context's total and what discounts take from it,
        and the left neighbours of its last two words."""
        contexts, cut = pair(u, v), np.array([0.0, *self.cut3])
        place = bucket_of(u, v, w, parts, self.buckets)
        order = np.lexsort((contexts, place))
        place, contexts, bigrams, w, hot = place[order], contexts[order], pair(v, w)[order], w[order], np.flatnonzero(parts[order] > 1)
        count, total, mass, lefts = np.zeros(len(w), np.int64), np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(w), np.int64)
        cuts = [*np.flatnonzero(np.append(True, place[1:] != place[:-1])).tolist(), len(w)] if len(w) else []
        for a, b in itertools.pairwise(cuts):
            file = self.bucket(int(place[a]))
            if file is not None:
                count[a:b], total[a:b], mass[a:b] = file.find(contexts[a:b], w[a:b], cut)
                lefts[a:b] = file.lefts_of(bigrams[a:b])
        by = hot[np.argsort(contexts[hot])]
        total[by], *seen = self.hot_contexts.find(contexts[by])
        mass[by] = sum(d * n for d, n in zip(self.cut3, seen, strict=True))
        by = hot[np.argsort(bigrams[hot])]
        lefts[by] = self.hot_bigrams.find(bigrams[by])[0]
        back = np.empty(len(w), np.int64)
        back[order] = np.arange(len(w))
        return count[back], total[back], mass[back], lefts[back]


def train(docs: DataFrame, size: int = BUCKET_TOKENS) -> Model:
    """Count and smooth; ``docs`` holds the training texts."""
    spark = docs.sparkSession
    counts = materialise(count_tokens(docs), "tokens")
    vocabulary = write_arrays(counts, "lm-vocabulary", [("c", "<i8")])
    total, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count("c")).first())
    ends = counts.where(F.col("key") == int(END.astype(np.int64))).first()
    starts = ends.c if ends else 0
    remove(counts)
    buckets = max(1, -(-total // size))
    folder = shared_path(spark, "lm-buckets")
    blocks = trigram_blocks(docs, vocabulary, starts, distinct, buckets, size)
    reduced = materialise(blocks.groupBy("bucket").applyInPandas(_merge(folder, _types(distinct)), REDUCED), "reduced")

    of = lambda kind: reduced.where(F.col("kind") == kind)
    sums = lambda rows, *names: rows.groupBy("key").agg(*[F.sum(x).alias(x) for x in names])
    few = lambda rows: {r.key: r.n for r in rows.groupBy("key").agg(F.sum("c").alias("n")).collect()}  # four rows
    capped = lambda rows, c: rows.select(F.least(c, F.lit(5)).cast("long").alias("key"), F.lit(1).alias("c"))
    cut3 = discounts(few(of(SEEN3)))
    hot = materialise(of(BIGRAM).groupBy("key").agg(F.sum("c").alias("c"), F.first("n1").alias("left"), F.first("n2").alias("right")), "hot")
    cut2 = discounts(few(of(SEEN2).select("key", "c").union(capped(hot, F.col("c")))))
    is_ = lambda k: F.sum((F.col("c") == k).cast("long"))
    hot_middles = hot.groupBy(F.col("left").alias("key")).agg(F.sum("c").alias("c"), is_(1).alias("n1"), is_(2).alias("n2"), F.sum((F.col("c") >= 3).cast("long")).alias("n3"))
    middles = of(MIDDLE).select("key", "c", "n1", "n2", "n3").union(hot_middles)
    continued = of(CONTINUED).select("key", "c").union(hot.groupBy(F.col("right").alias("key")).agg(F.count(F.lit(1)).alias("c")))
    zero = F.lit(0).cast("long")
    mass = sum(F.lit(float(d)) * F.col(n) for d, n in zip(cut2, ("n1", "n2", "n3"), strict=True))
    words = continued.select("key", F.col("c").alias("k"), zero.alias("total"), F.lit(0.0).alias("mass")).union(middles.select("key", zero, "c", mass))
    words = materialise(sums(words, "k", "total", "mass"), "words")
    by_count = few(capped(words.where("k > 0"), F.col("k")))
    cut1 = discounts(by_count)
    types = words.agg(F.sum("k")).first()[0] or 0
    lost = cut1[0] * by_count.get(1, 0) + cut1[1] * by_count.get(2, 0) + cut1[2] * sum(by_count.get(i, 0) for i in (3, 4, 5))
    statistics = [(c, "<i8") for c in ("c", "n1", "n2", "n3")]
    model = Model(
        vocabulary=vocabulary,
        words=write_arrays(words, "lm-words", [("k", "<i8"), ("total", "<i8"), ("mass", "<f8")]),
        hot_contexts=write_arrays(sums(of(CONTEXT), "c", "n1", "n2", "n3"), "lm-hot-contexts", statistics),
        hot_bigrams=write_arrays(hot.select("key", "c"), "lm-hot-bigrams", [("c", "<i8")]),
        folder=folder, buckets=buckets, size=size, total=total, distinct=distinct, starts=starts, types=types,
        unknown=(lost / types if types else 1.0) / (distinct + 1), cut1=cut1, cut2=cut2, cut3=cut3,
    )
    for used in (reduced, hot, words):
        remove(used)
    return model


def score_texts(docs: DataFrame, folds: int = 5, size: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = train(kept.where(~held_out("doc_id", folds)), size)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # paths and constants, not the arrays

    def scan(batches):
        for batch in batches:
            for i, j, data, offsets in row_chunks(batch.column(1), CHUNK):
                columns = shared.value.score(*tokens(data, offsets), j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    key = docs.schema["doc_id"].dataType.simpleString()
    scored = materialise(kept.mapInArrow(scan, f"doc_id {key}, n_tokens long, n_known long, base_score double, score double"), "scores")
    model.remove(docs.sparkSession)
    return scored.select(
        "doc_id", held_out("doc_id", folds).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )

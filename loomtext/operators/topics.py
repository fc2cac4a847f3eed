"""Topic models over whole vocabularies, their diagnostics, and how models are compared."""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import storage
from .ranks import correlation


def tokenised(docs: DataFrame) -> DataFrame:
    """The documents' other columns and their words, of those that have any."""
    keep = [c for c in docs.columns if c not in ("text", "tokens")]
    return docs.select(*keep, F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("tokens")).where(F.size("tokens") > 0)


def most(rows: DataFrame, n: int | None) -> DataFrame:
    """The first n rows, all without a bound."""
    return rows if n is None else rows.limit(n)


def vectorised(docs: DataFrame, min_df: float = 5, max_df: float = 0.85, max_features: int | None = None) -> tuple[list[str], DataFrame]:
    """(vocabulary, docs with ids and counts of their terms in place of the words).
    The most frequent words come first, equally frequent ones by name; ``max_features`` bounds
    their number if asked for; bounds below 1, and 1.0, are shares of the documents."""
    tokens = storage.written(tokenised(docs), "tokens")
    n = tokens.count()
    low, high = (x if x > 1 or isinstance(x, int) else x * n for x in (min_df, max_df))

    def tally(batches):
        for batch in batches:
            lists = batch.column(0)
            doc, coded = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten().dictionary_encode()
            code, m = coded.indices.to_numpy(), len(coded.dictionary)
            tf, df = np.bincount(code, minlength=m), np.bincount(np.unique(doc * m + code) % max(m, 1), minlength=m)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(tf), pa.array(df)], ["word", "tf", "df"])

    found = tokens.select("tokens").mapInArrow(tally, "word string, tf long, df long").groupBy("word").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where(F.col("df").between(low, high))
    words = [r.word for r in most(found.orderBy(F.desc("tf"), "word"), max_features).select("word").collect()]
    shared, keep = docs.sparkSession.sparkContext.broadcast(words), [c for c in tokens.columns if c != "tokens"]

    def count(batches):
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            lists = batch.column(0)
            doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            term = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy()
            pairs, counts = np.unique((doc * len(known) + term)[term >= 0], return_counts=True)
            doc, term = np.divmod(pairs, max(len(known), 1))
            cuts = pa.array(np.searchsorted(doc, np.arange(len(lists) + 1)).astype(np.int32))
            found = (pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (term.astype(np.int32), counts.astype(float)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found], [*keep, "ids", "counts"])

    kinds = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in keep)
    return words, tokens.select("tokens", *keep).mapInArrow(count, f"{kinds + ', ' if kinds else ''}ids array<int>, counts array<double>")


def fit_topics(docs: DataFrame, k: int = 12, passes: int = 12, seed: int = 42, min_df: int = 5, max_df: float = 0.85, max_features: int | None = None):
    """(vocabulary, online variational model, documents' term counts); ``docs`` has doc_id."""
    words, rows = vectorised(docs.select("doc_id", "text"), min_df, max_df, max_features)
    batches = Minibatches(rows)
    return words, OnlineLDA(k, len(words), seed).fit(batches, passes), batches


def topic_words(words: list[str], model, n: int = 10) -> DataFrame:
    """topic, rank, word, weight; of equal weights the more frequent word first."""
    beta = model.components / model.components.sum(1, keepdims=True)
    top = np.argsort(-beta, axis=1, kind="stable")[:, :n]
    out = [(t, r + 1, words[w], float(beta[t, w])) for t, own in enumerate(top) for r, w in enumerate(own)]
    return SparkSession.active().createDataFrame(out, "topic int, rank int, word string, weight double")


def topic_prevalence(model, rows: DataFrame, *groups: str) -> DataFrame:
    """Mean share in percent and number of dominated documents of each topic, overall or for
    each group (such as a year); ``rows`` as ``vectorised`` gives them. Documents without a
    term have no share of any topic."""
    mixed = model.mixtures(rows.withColumn("_any", F.size("ids") > 0), *groups, "_any")
    return mixture_prevalence(mixed.withColumn("p", F.when(F.col("_any"), F.col("p")).otherwise(F.transform("p", lambda _: F.lit(0.0)))), "p", *groups)


def mixture_prevalence(mixed: DataFrame, p: str, *groups: str) -> DataFrame:
    """The same from an array of shares; of equal shares the first topic dominates."""
    shares = mixed.select(*groups, F.col(p).alias("_p"), F.posexplode(p).alias("topic", "share"))
    dominant = (F.array_position("_p", F.array_max("_p")) - 1 == F.col("topic")).cast("long")
    return shares.groupBy(*groups, "topic").agg((100 * F.avg("share")).alias("prevalence_pct"), F.sum(dominant).alias("dominant_documents"), F.count(F.lit(1)).alias("n_documents"))


# --- batch variational Bayes -----------------------------------------------


#: Numbers whose digamma is found at once, so that what lies between stays in the cache.
BLOCK = 1 << 13


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence to arguments six larger, then the asymptotic series."""
    x = np.asarray(x, float)
    if x.size > BLOCK:
        return np.concatenate([_digamma(x.reshape(-1)[i : i + BLOCK]) for i in range(0, x.size, BLOCK)]).reshape(x.shape)
    return _digamma(x)


def _digamma(x: np.ndarray) -> np.ndarray:
    t = x * (x + 5)  # 1/x + 1/(x+5) is (2x+5) / t, the next two (2x+5) / (t+4) and (2x+5) / (t+6)
    y = 1 / (z := x + 6)
    half, y = 0.5 * y, y * y
    return np.log(z) - half - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - (2 * x + 5) * ((3 * t + 20) * t + 24) / (t * ((t + 10) * t + 24))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    y = 1 / (z := x + 6)
    q = y * y
    return y + q / 2 + y * q * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q / 30))) + sum(1 / (x + i) ** 2 for i in range(6))


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    t, z = x * (x + 5), x + 6
    q = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q / 1680))) / z - np.log(t) - np.log((t + 4) * (t + 6))


def mixture(ids: np.ndarray, counts: np.ndarray, words: np.ndarray, prior: float, steps: int = 100, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """One document's variational topic weights, and its expected counts (topics x its words)
    over ``words``; ``words`` is exp(E[log beta])."""
    own = words[:, ids]
    gamma = np.ones(len(words))
    for _ in range(steps):
        theta = np.exp(digamma(gamma) - digamma(np.array([gamma.sum()]))[0])
        fresh = prior + theta * (own @ (counts / (theta @ own + 1e-100)))
        change, gamma = np.abs(fresh - gamma).mean(), fresh
        if change < tolerance:
            break
    theta = np.exp(digamma(gamma) - digamma(np.array([gamma.sum()]))[0])
    return gamma, theta[:, None] * (counts / (theta @ own + 1e-100))


#: Documents whose topic weights are found together; no result depends on it.
TOGETHER = 256


def mixtures_of(batch: pa.RecordBatch, words: np.ndarray, prior: float, steps: int = 100, tolerance: float = 1e-3) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, gamma, expected counts) as ``mixture`` for each document (ids, counts) of a batch:
    every document ends at its own tolerance, the functions of all weights are taken at once."""
    for start in range(0, batch.num_rows, TOGETHER):
        part = batch.slice(start, TOGETHER)
        ids = [np.array(x, np.int64) for x in part.column(0).to_pylist()]
        counts = [np.array(x, float) for x in part.column(1).to_pylist()]
        own = [words[:, i] for i in ids]
        gamma, active = np.ones((len(ids), len(words))), np.arange(len(ids))
        shares = lambda g: np.exp(digamma(g) - digamma(g.sum(1, keepdims=True)))
        for _ in range(steps):
            fresh = np.array([prior + t * (own[d] @ (counts[d] / (t @ own[d] + 1e-100))) for d, t in zip(active, shares(gamma[active]), strict=True)])
            change, gamma[active] = np.abs(fresh - gamma[active]).mean(1), fresh
            active = active[change >= tolerance]
            if not len(active):
                break
        for d, t in enumerate(shares(gamma)):
            yield ids[d], gamma[d], t[:, None] * (counts[d] / (t @ own[d] + 1e-100))


#: Most steps to a document's weights, as in ``mixture``; documents of a batch whose expected counts
#: are found at once, on which no result depends beyond rounding.
STEPS, AT_ONCE = 100, 4096


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    """The lists as arrays of their own."""
    return np.split(lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())[:-1]) if len(lists) else []


class BatchLDA:
    """Latent Dirichlet allocation by batch variational Bayes: each iteration is one pass over
    all documents, whose expected counts are summed by word and topic where they lie."""

    def __init__(self, k: int, vocabulary: int, seed: int = 42, prior: float | None = None, word_prior: float | None = None):
        self.k, self.prior, self.word_prior = k, prior or 1 / k, word_prior or 1 / k
        self.components = np.random.default_rng(seed).gamma(100.0, 0.01, (k, vocabulary))

    def expected(self) -> np.ndarray:
        return np.exp(digamma(self.components) - digamma(self.components.sum(1, keepdims=True)))

    def fit(self, rows: DataFrame, iterations: int = 50) -> BatchLDA:
        """``rows`` has ids (array of term numbers) and counts."""
        for _ in range(iterations):
            self.components = self.step(rows)
        return self

    def step(self, rows: DataFrame) -> np.ndarray:
        """As many tasks as cores, each of which sends the expected counts of its words once,
        straight to the driver: no shuffle is left on disk by a pass."""
        spark, prior = rows.sparkSession, np.full(self.k, self.prior)
        shared = spark.sparkContext.broadcast(self.expected().T.copy())  # vocabulary x topics

        def count(batches):
            words = shared.value
            total = np.zeros_like(words)
            for batch in batches:
                for start in range(0, batch.num_rows, AT_ONCE):
                    ids, counts = (_arrays(batch.column(i).slice(start, AT_ONCE)) for i in (0, 1))
                    total += expected_of(ids, [c.astype(float) for c in counts], words, prior, STEPS)[0]
            held = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (held.astype(np.int32), total[held])], ["words", "n"])

        out = np.full((self.components.shape[1], self.k), self.word_prior)
        for r in rows.select("ids", "counts").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(count, "words binary, n binary").collect():  # a row a task
            out[np.frombuffer(r.words, np.int32)] += np.frombuffer(r.n).reshape(-1, self.k)
        shared.destroy()
        return out.T

    def mixtures(self, rows: DataFrame, *keep: str) -> DataFrame:
        """``keep`` and p, the topic shares of each document."""
        spark, prior = rows.sparkSession, self.prior
        shared = spark.sparkContext.broadcast(self.expected())

        def mix(batches):
            for batch in batches:
                out = [gamma / gamma.sum() for _, gamma, _ in mixtures_of(batch, shared.value, prior)]
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array([list(p) for p in out], pa.list_(pa.float64()))], [*keep, "p"])

        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.select("ids", "counts", *keep).mapInArrow(mix, f"{kinds + ', ' if kinds else ''}p array<double>")


# --- online variational Bayes ----------------------------------------------


#: Tasks that share the documents of a minibatch (another number deals them otherwise); documents
#: whose weights are found together and the weights of their words with padding, on which no result
#: depends beyond rounding. So many weights stay in a core's cache.
PARTS, SIDE_BY_SIDE, PADDED = 6, 256, 1 << 17


def _shares(gamma: np.ndarray) -> np.ndarray:
    each = digamma(np.concatenate([gamma, gamma.sum(-1, keepdims=True)], -1))
    return each[..., :-1] - each[..., -1:]


def weights_of(ids: list[np.ndarray], counts: list[np.ndarray], words: np.ndarray, prior: np.ndarray, tolerance: float = 1e-3, steps: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places of documents, their gamma, padded ids, padded expected shares by word and count)
    until all documents are told; each goes on until its own mean change is at most
    ``tolerance``, or for ``steps`` if given. ``words`` is exp(E[log beta]), vocabulary x topics; padding has count 0.
    The slowest quarter of a batch goes on in later batches, with those of others."""
    sizes, weights = np.array([len(x) for x in ids], np.int64), np.ones((len(ids), words.shape[1]))
    taken = np.zeros(len(ids), np.int64)
    left, room = np.argsort(sizes, kind="stable"), PADDED // words.shape[1]
    while len(left):
        start, later = 0, [left[:0]]
        while start < len(left):
            near = sizes[left[start : start + SIDE_BY_SIDE]]
            docs = left[start : start + max(1, int((near * np.arange(1, len(near) + 1) <= room).sum()))]
            wide, slowest = int(sizes[docs[-1]]), len(docs) // 4 if len(docs) < len(left) else 0
            start += len(docs)
            places, n = np.zeros((len(docs), wide), np.int64), np.zeros((len(docs), wide))
            for row, d in enumerate(docs):
                places[row, : sizes[d]], n[row, : sizes[d]] = ids[d], counts[d]
            gamma, active = weights[docs], np.arange(len(docs))
            every = own = words.take(places, axis=0)
            held, going = n, np.ones(len(docs), bool)
            while (many := np.count_nonzero(going)) > slowest:
                if many < 0.7 * len(going):  # the others are left behind
                    active, own, held, going = active[going], own[going], held[going], going[going]
                before = gamma[active]
                theta = np.exp(_shares(before))
                ratio = np.matmul(own, theta[:, :, None])[:, :, 0] + 1e-100
                fresh = prior + theta * np.matmul(np.divide(held, ratio, out=ratio)[:, None], own)[:, 0]
                moved = np.abs(fresh - before).sum(1) > tolerance * fresh.shape[1]
                gamma[active[going]] = fresh[going]
                going &= moved
                if steps:
                    taken[docs[active]] += 1
                    going &= taken[docs[active]] < steps
            weights[docs] = gamma
            later.append(docs[active[going]])
            if many:
                told = np.ones(len(docs), bool)
                told[active[going]] = False
                docs, gamma, places, n, every = docs[told], gamma[told], places[told], n[told], every[told]
            theta = np.exp(_shares(gamma))
            yield docs, gamma, places, n / (np.matmul(every, theta[:, :, None])[:, :, 0] + 1e-100)
        left = np.concatenate(later)
        left = left[np.argsort(sizes[left], kind="stable")]


def expected_of(ids: list[np.ndarray], counts: list[np.ndarray], words: np.ndarray, prior: np.ndarray, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of documents (vocabulary x topics), and their expected log shares summed."""
    found = [(places.reshape(-1), ratio, _shares(gamma)) for _, gamma, places, ratio in weights_of(ids, counts, words, prior, steps=steps)]
    theta, every = [np.exp(logs) for _, _, logs in found], np.concatenate([x[0] for x in found])
    total, each = np.empty(words.shape), np.empty(len(every))
    cuts = np.cumsum([0, *(len(x[0]) for x in found)])
    for topic in range(len(prior)):
        for (_, ratio, _), t, start, end in zip(found, theta, cuts, cuts[1:], strict=False):
            np.multiply(ratio, t[:, topic, None], out=each[start:end].reshape(ratio.shape))
        total[:, topic] = np.bincount(every, each, len(words))
    return total * words, sum(logs.sum(0) for _, _, logs in found)


def _unpacked(arrays: bytes) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    words, place, counts, sizes = pickle.loads(arrays)
    cuts = np.cumsum(sizes)[:-1]
    return words, np.split(place, cuts), np.split(counts.astype(float), cuts)


class Minibatches:
    """Documents (doc_id, ids, counts) dealt by their id into minibatches of about ``batch``,
    each visited once in a pass. A minibatch lies in ``tasks`` partitions of its own (a divisor of
    ``PARTS``; the same documents whichever), on the executors' disks, so a step reads no other
    documents; the driver keeps the words of each if it takes the steps."""

    def __init__(self, rows: DataFrame, batch: int = 1024, tasks: int = PARTS):
        rows = storage.written(rows, "terms")
        self.n = rows.count()  # with those without a term, as in Spark's model
        self.steps = max(1, -(-self.n // batch))
        self.tasks = tasks
        dealt = F.pmod(F.xxhash64("doc_id"), F.lit(self.steps * PARTS))
        known = rows.where(F.size("ids") > 0).select(F.floor(dealt / (PARTS // tasks)).cast("int").alias("slot"), "doc_id", "ids", "counts")

        def packed(table: pa.Table) -> pa.Table:
            table = table.sort_by([("doc_id", "ascending"), ("size", "ascending")])
            ids, counts = (table.column(c).combine_chunks() for c in ("ids", "counts"))
            own, place = np.unique(ids.flatten().to_numpy(), return_inverse=True)
            arrays = own.astype(np.int32), place.astype(np.int32), counts.flatten().to_numpy().astype(np.float32), np.diff(ids.offsets.to_numpy())
            return pa.table({"slot": table.column("slot").slice(0, 1), "arrays": pa.array([pickle.dumps(arrays)], pa.binary())})

        # A group is one part of a minibatch.
        found = known.withColumn("size", F.size("ids")).groupBy("slot").applyInArrow(packed, "slot int, arrays binary").rdd
        self.parts = found.map(lambda r: (r.slot, bytes(r.arrays))).partitionBy(self.steps * tasks, int).persist(StorageLevel.DISK_ONLY)

    @cached_property
    def words(self) -> dict[int, np.ndarray]:
        return dict(self.parts.mapValues(lambda x: pickle.loads(x)[0]).collect())

    @cached_property
    def known(self) -> list[int]:
        """Slots that hold documents."""
        return sorted(self.parts.keys().collect())

    def slots(self, at: int) -> list[int]:
        return [s for s in range(at * self.tasks, (at + 1) * self.tasks) if s in self.words]

    def run(self, f, slots: list[int]) -> list:
        """f(slot, words, ids, counts) of each slot, each a task of its own."""

        def each(found):
            for slot, arrays in found:
                yield f(slot, *_unpacked(arrays))

        return self.parts.context.runJob(self.parts, each, slots)

    def through(self, f, times: int = 1):
        """f(slots in order, ``times`` over, each with words, ids and counts), all in one task,
        which holds one slot at a time; those that come early wait as they are."""
        order = self.known * times

        def each(found):
            def in_order():
                waiting = defaultdict(list)
                for due in order:
                    while not waiting[due]:
                        slot, arrays = next(found)
                        waiting[slot].append(arrays)
                    yield due, *_unpacked(waiting[due].pop())

            yield f(in_order())

        # Made one partition before the union, which else puts the copies of a slot together.
        once = self.parts.coalesce(1)
        (out,) = self.parts.context.union([once] * times).coalesce(1).mapPartitions(each).collect()
        return out

    def release(self) -> None:
        self.parts.unpersist()


class OnlineLDA:
    """Latent Dirichlet allocation by online variational Bayes, as Spark's (Hoffman's updates,
    offset 1024, decay 0.51, the documents' prior learned), but a step reads, sends and changes
    only what its minibatch holds: weights fade by a factor kept apart from them."""

    def __init__(self, k: int, vocabulary: int, seed: int = 42, offset: float = 1024, decay: float = 0.51):
        self.k, self.prior, self.word_prior, self.offset, self.decay, self.done = k, np.full(k, 1 / k), 1 / k, offset, decay, 0
        self._fade, self._above = 1.0, np.random.default_rng(seed).gamma(100.0, 0.01, (vocabulary, k)) - self.word_prior
        self._sums = self._above.sum(0) + vocabulary * self.word_prior

    @property
    def components(self) -> np.ndarray:
        """Topics x vocabulary."""
        return (self.word_prior + self._fade * self._above).T

    def fit(self, batches: Minibatches, passes: int) -> OnlineLDA:
        for step in range(passes * batches.steps):
            self.step(batches, step % batches.steps)
        return self

    def step(self, batches: Minibatches, at: int) -> None:
        slots = batches.slots(at)
        self.done += 1
        if not slots:
            return
        prior = self.prior
        sums = digamma(self._sums)
        # Single precision on the way: far closer than the tolerance of the documents' weights.
        # Sent at once and each word once.
        every = np.unique(np.concatenate([batches.words[s] for s in slots]))
        shared = batches.parts.context.broadcast((every, (self.word_prior + self._fade * self._above[every]).astype(np.float32)))

        def count(slot, own, ids, counts):
            held, weights = shared.value
            words = np.exp(digamma(weights[np.searchsorted(held, own)]) - sums)
            total, shares = expected_of(ids, counts, words, prior)
            return slot, total.astype(np.float32), shares, len(ids)

        found = batches.run(count, slots)
        shared.destroy()
        self._update([(batches.words[slot], total.astype(float), shares, n) for slot, total, shares, n in found], batches.n, batches.steps)

    def _update(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], n: int, steps: int) -> None:
        """By words, their expected counts, shares and documents of each part of a minibatch; ``n``
        documents in ``steps`` minibatches in all."""
        rho = (self.offset + self.done) ** -self.decay
        grow = rho * n / -(-n // steps)
        self._fade *= 1 - rho
        self._sums = (1 - rho) * self._sums + rho * len(self._above) * self.word_prior
        for words, total, _, _ in found:
            self._above[words] += total * (grow / self._fade)
            self._sums += grow * total.sum(0)
        if self._fade < 1e-100:
            self._above *= self._fade
            self._fade = 1.0
        self._learn_prior(sum(x[2] for x in found), sum(x[3] for x in found), rho)

    def _learn_prior(self, shares: np.ndarray, n: int, rho: float) -> None:
        """One weighted Newton step (Huang), taken if all stays above 0."""
        slope = n * (shares / n - _shares(self.prior))
        c, q = n * trigamma(self.prior.sum()), -n * trigamma(self.prior)
        change = -(slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
        if (rho * change + self.prior > 0).all():
            self.prior = self.prior + rho * change

    def log_perplexity(self, batches: Minibatches) -> float:
        """Minus the variational bound of the documents, by their number of tokens."""
        shared, rest = batches.parts.context.broadcast(self._above), copy(self)
        rest._above = None

        def bound(_, own, ids, counts):
            return rest._bound(shared.value[own], ids, counts)

        found = batches.run(bound, list(range(batches.steps * batches.tasks)))
        shared.destroy()
        return self._perplexity(found)

    def _bound(self, above: np.ndarray, ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[float, float]:
        """The documents' part of the bound and their tokens; ``above`` has their words' rows."""
        prior, words = self.prior, np.exp(logs := digamma(self.word_prior + self._fade * above) - digamma(self._sums))
        total = tokens = 0.0
        for docs, gamma, places, _ in weights_of(ids, counts, words, prior):
            share = _shares(gamma)
            total += ((prior - gamma) * share + log_gamma(gamma) - log_gamma(prior)).sum() + (log_gamma(prior.sum()) - log_gamma(gamma.sum(1))).sum()
            for row, d in enumerate(docs):
                of = share[row] + logs[places[row, : len(ids[d])]]
                most = of.max(1)
                total += counts[d] @ (most + np.log(np.exp(of - most[:, None]).sum(1)))
                tokens += counts[d].sum()
        return total, tokens

    def _perplexity(self, found: list[tuple[float, float]]) -> float:
        low, v, sums = self.word_prior, len(self._above), digamma(self._sums)

        def of_words(above: np.ndarray) -> float:
            weights = low + self._fade * above
            return ((low - weights) * (digamma(weights) - sums) + log_gamma(weights) - log_gamma(low)).sum()

        topics = math.fsum(of_words(self._above[i : i + BLOCK]) for i in range(0, v, BLOCK)) + (log_gamma(v * low) - log_gamma(self._sums)).sum()
        return float(-(math.fsum(x[0] for x in found) + topics) / math.fsum(x[1] for x in found))

    def mixtures(self, rows: DataFrame, *keep: str) -> DataFrame:
        """``keep`` and p, the topic shares of each document (ids, counts)."""
        shared, prior = rows.sparkSession.sparkContext.broadcast(np.exp(digamma(self.word_prior + self._fade * self._above) - digamma(self._sums))), self.prior

        def mix(batches):
            for batch in batches:
                ids, counts = ([np.array(x, kind) for x in batch.column(i).to_pylist()] for i, kind in ((0, np.int64), (1, float)))
                out = np.zeros((len(ids), len(prior)))
                for docs, gamma, _, _ in weights_of(ids, counts, shared.value, prior):
                    out[docs] = gamma / gamma.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out.tolist(), pa.list_(pa.float64()))], [*keep, "p"])

        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.select("ids", "counts", *keep).mapInArrow(mix, f"{kinds + ', ' if kinds else ''}p array<double>")


def fit_in_a_task(batches: Minibatches, passes: int, k: int, vocabulary: int, seed: int = 42) -> tuple[np.ndarray, float]:
    """(components, log_perplexity) of an ``OnlineLDA`` whose steps one task
    takes one after another: for models fitted beside each other, since a step is too little work
    to be shared. The updates are the same; ``batches`` has one task for a minibatch."""
    if batches.tasks > 1:
        raise ValueError("a model in one task takes minibatches of one task")
    steps, n, each = batches.steps, batches.n, len(batches.known)

    def fit(found):
        model = OnlineLDA(k, vocabulary, seed)
        for done in range(passes):
            for at, own, ids, counts in islice(found, each):
                words = np.exp(digamma(model.word_prior + model._fade * model._above.take(own, axis=0)) - digamma(model._sums))
                model.done = done * steps + at + 1
                model._update([(own, *expected_of(ids, counts, words, model.prior), len(ids))], n, steps)
        score = model._perplexity([model._bound(model._above.take(own, axis=0), ids, counts) for _, own, ids, counts in found])
        return model.components, score

    return batches.through(fit, passes + 1)


def term_arrays(docs: DataFrame, min_df: float = 5, max_df: float = 0.85, max_features: int | None = None) -> tuple[list[str], DataFrame]:
    """The vocabulary (in order; the ``max_features`` most frequent, if asked for) and the documents'
    other columns with ids and counts of their terms; documents without a term are left out.
    Bounds below 1 are shares of the documents."""
    tokens = tokenised(docs)
    counted = tokens.select("doc_id", F.explode("tokens").alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    n = tokens.count()
    low, high = (x if x >= 1 and not isinstance(x, float) else x * n for x in (min_df, max_df))
    found = counted.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df").between(low, high))
    words = sorted(r.word for r in most(found.orderBy(F.desc("total"), "word"), max_features).select("word").collect())
    table = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(words)), "i int, word string"))
    rows = counted.join(table, "word").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "tf"))).alias("t"))  # one text's terms
    return words, tokens.drop("tokens").join(rows, "doc_id").withColumn("ids", F.col("t.i")).withColumn("counts", F.col("t.tf")).drop("t")


# --- comparing models ------------------------------------------------------


def best_assignment(cost: list[list[float]]) -> list[int]:
    """For each row a column of its own at least total cost, by shortest augmenting paths: the
    work grows with the cube of the size. With fewer columns than rows, -1 for rows left over."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if n > m:
        turned = best_assignment([list(c) for c in zip(*cost, strict=True)])
        return [turned.index(i) if i in turned else -1 for i in range(n)]
    row_price, column_price, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, came, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[at]:
            done[at], here, delta, next_ = True, owner[at], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    reduced = cost[here - 1][j - 1] - row_price[here] - column_price[j]
                    if reduced < least[j]:
                        least[j], came[j] = reduced, at
                    if least[j] < delta:
                        delta, next_ = least[j], j
            for j in range(m + 1):
                if done[j]:
                    row_price[owner[j]] += delta
                    column_price[j] -= delta
                else:
                    least[j] -= delta
            at = next_
        while at:
            owner[at], at = owner[came[at]], came[at]
    out = [-1] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return unit(a) @ unit(b).T


def top_words(components: np.ndarray, n: int) -> list[list[int]]:
    """The n heaviest words of each topic, the later one first where weights are equal."""
    return np.argsort(components, axis=1, kind="stable")[:, ::-1][:, :n].tolist()


def _jaccard(a: list[int], b: list[int]) -> float:
    return len({*a} & {*b}) / max(len({*a} | {*b}), 1)


def matched_topics(reference: np.ndarray, other: np.ndarray, n: int = 15) -> list[tuple[int, int, float, float]]:
    """(reference topic, matched topic, cosine, Jaccard of the top words), one to one, topics from 1."""
    similar, mine, theirs = cosines(reference, other), top_words(reference, n), top_words(other, n)
    pairs = enumerate(best_assignment((-similar).tolist()))
    return [(i + 1, j + 1, float(similar[i, j]), _jaccard(mine[i], theirs[j])) for i, j in pairs if j >= 0]


def nearest_topics(reference: np.ndarray, other: np.ndarray, n: int = 10) -> list[tuple[int, int, float, int, float, int]]:
    """(reference topic, its most similar topic, cosine, shared top words, their Jaccard, how many
    reference topics have that same nearest one), topics from 1."""
    similar, mine, theirs = cosines(reference, other), top_words(reference, n), top_words(other, n)
    best = similar.argmax(1)
    return [(i + 1, int(j) + 1, float(similar[i, j]), len({*mine[i]} & {*theirs[j]}), _jaccard(mine[i], theirs[j]), int((best == j).sum())) for i, j in enumerate(best)]


def diversity(components: np.ndarray, n: int = 15) -> float:
    return len({w for t in top_words(components, n) for w in t}) / (len(components) * n)


def pair_counts(words: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, n: in how many documents (doc_id, tokens) both words stand, a before or equal to b;
    only the words asked for (word) leave a document."""
    wanted = F.broadcast(words.select("word").distinct())  # lists
    held = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("word")).join(wanted, "word").groupBy("doc_id").agg(F.collect_set("word").alias("own"))
    pairs = F.explode(F.flatten(F.transform("own", lambda a: F.transform(F.filter("own", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")
    return held.select(pairs).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).cast("double").alias("n"))


def npmi(lists: DataFrame, docs: DataFrame) -> DataFrame:
    """topic, npmi: the mean over the pairs of each topic's words (topic, word) of their
    normalised pointwise information over documents (doc_id, tokens). A pair that never meets
    has -1, one in every document 1; a word that no document holds takes no part as the later
    of a pair. Documents are read once; only listed words leave them."""
    words = lists.select("topic", "rank", "word")
    counts = pair_counts(words, docs)
    single = counts.where("a = b").select(F.col("a").alias("w"), F.col("n").alias("k"))
    total = docs.agg(F.count(F.lit(1)).cast("double").alias("total"))
    x, y = words.alias("x"), words.alias("y")
    pairs = x.join(y, (F.col("x.topic") == F.col("y.topic")) & (F.col("x.rank") > F.col("y.rank"))).select("x.topic", F.col("x.word").alias("i"), F.col("y.word").alias("j"))
    known = pairs.join(single.select(F.col("w").alias("i"), F.col("k").alias("ki")), "i").join(single.select(F.col("w").alias("j"), F.col("k").alias("kj")), "j", "left")
    met = known.join(counts, (F.least("i", "j") == F.col("a")) & (F.greatest("i", "j") == F.col("b")), "left").crossJoin(F.broadcast(total))  # one row
    value = F.when(F.col("n").isNull(), -1.0).when(F.col("n") == F.col("total"), 1.0).otherwise(F.log(F.col("n") * F.col("total") / (F.col("ki") * F.col("kj"))) / -F.log(F.col("n") / F.col("total")))
    found = met.groupBy("topic").agg(F.avg(value).alias("npmi"))
    return lists.select("topic").distinct().join(found, "topic", "left")


def window_types(docs: DataFrame, size: int = 110) -> DataFrame:
    """doc_id, n_windows and n_types: the distinct words of every window of ``size`` words,
    summed. A word adds one to each window whose first occurrence of it this is, so a window
    function over the word's own places counts them, without the windows."""
    places = tokenised(docs.select("doc_id", "text")).select("doc_id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "word"))
    before = F.lag("at").over(Window.partitionBy("doc_id", "word").orderBy("at"))
    last = F.greatest(F.lit(0), F.col("n") - size)
    first = F.greatest(F.lit(0), F.col("at") - size + 1, F.coalesce(before + 1, F.lit(0)))
    counted = places.select("doc_id", "n", F.greatest(F.lit(0), F.least("at", last) - first + 1).cast("long").alias("k"))
    sums = counted.groupBy("doc_id").agg((F.greatest(F.lit(0), F.max("n") - size) + 1).cast("long").alias("n_windows"), F.sum("k").alias("n_types"))
    every = docs.select("doc_id").join(sums, "doc_id", "left")
    return every.select("doc_id", F.coalesce("n_windows", F.lit(1)).cast("long").alias("n_windows"), F.coalesce("n_types", F.lit(0)).cast("long").alias("n_types"))


def window_coherence(lists: DataFrame, docs: DataFrame, size: int = 110) -> DataFrame:
    """topic, c_v: for each word of a topic (topic, word) its information with each of the
    topic's words, over windows of ``size`` words; the mean cosine of these vectors with their
    sum. Only listed words and the number of windows leave a document."""
    words = [r.word for r in lists.select("word").distinct().orderBy("word").collect()]  # the lists
    place, parts = {w: i for i, w in enumerate(words)}, docs.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        own = {w: i for i, w in enumerate(parts.value)}
        both, windows = np.zeros((len(own), len(own))), 0
        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                n = max(1, len(tokens) - size + 1)
                windows += n
                change: dict[int, np.ndarray] = {}
                for at, word in enumerate(tokens):
                    i = own.get(word)
                    if i is not None:
                        steps = change.setdefault(i, np.zeros(n + 1, np.int32))
                        steps[max(0, at - size + 1)] += 1
                        steps[min(at, n - 1) + 1] -= 1
                ids = list(change)
                held = np.array([np.cumsum(change[i][:n]) > 0 for i in ids], np.float32).reshape(len(ids), n)
                both[np.ix_(ids, ids)] += held @ held.T
        a, b = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(a, -1).astype(np.int32)), pa.array(np.append(b, -1).astype(np.int32)), pa.array(np.append(both[a, b], windows))], ["a", "b", "n"])

    found = docs.select("tokens").mapInArrow(count, "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()  # pairs of listed words
    total = float(found.loc[found["a"] < 0, "n"].sum())
    p = np.zeros((len(words), len(words)))
    known = found[found["a"] >= 0]
    p[known["a"], known["b"]] = known["n"] / total if total else 0
    out = []
    for topic, own in lists.groupBy("topic").agg(F.collect_list("word")).collect():
        at = [place[w] for w in own if p[place[w], place[w]] > 0]
        if at:
            joint, single = p[np.ix_(at, at)], p[at, at]
            m = np.log((joint + 1e-12) / np.outer(single, single)) / -np.log(joint + 1e-12)
            whole = m.sum(0)
            out.append((topic, float(np.mean(m @ whole / (np.linalg.norm(m, axis=1) * np.linalg.norm(whole))))))
    return docs.sparkSession.createDataFrame(out, f"topic {lists.schema['topic'].dataType.simpleString()}, c_v double")


def exclusivity(weights: DataFrame, topic: str, word: str, weight: str, n: int = 10) -> DataFrame:
    """The mean, over a topic's n heaviest words, of the topic's share of the word's weights (each
    topic's weights made to sum to one)."""
    sums = weights.groupBy(topic).agg(F.sum(weight).alias("_all"))
    beta = weights.join(F.broadcast(sums), topic).select(topic, word, (F.col(weight) / F.col("_all")).alias("_beta"))  # one row a topic
    listed = beta.withColumn("_r", F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("_beta"), word))).where(F.col("_r") <= n)
    total = beta.join(F.broadcast(listed.select(word).distinct()), word).groupBy(word).agg(F.sum("_beta").alias("_sum"))
    return listed.join(F.broadcast(total), word).groupBy(topic).agg(F.avg(F.col("_beta") / F.col("_sum")).alias("exclusivity"))


def yearly_correlation(reference: DataFrame, other: DataFrame, matches: list[tuple[int, int]]) -> DataFrame:
    """reference_topic, other_topic, rho: the rank correlation of two topics' shares (year, topic,
    prevalence_pct, topics from 0) over the years that both have; null for fewer than three."""
    spark = reference.sparkSession
    pairs = F.broadcast(spark.createDataFrame([(int(a), int(b)) for a, b in matches], "reference_topic int, other_topic int"))
    a = reference.select("year", (F.col("topic") + 1).alias("reference_topic"), F.col("prevalence_pct").alias("x")).join(pairs, "reference_topic")
    joined = a.join(other.select("year", (F.col("topic") + 1).alias("other_topic"), F.col("prevalence_pct").alias("y")), ["year", "other_topic"])
    w = Window.partitionBy("reference_topic", "other_topic")  # a pair's years
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("reference_topic", "other_topic", c)) - 1) / 2
    ranked = joined.withColumn("rx", rank("x")).withColumn("ry", rank("y")).groupBy("reference_topic", "other_topic")
    return ranked.agg(F.when(F.count(F.lit(1)) >= 3, correlation("rx", "ry")).alias("rho"))


def reconstruction_errors(saved: DataFrame, computed: DataFrame, words: int = 10, weight: float = 6e-5, prevalence: float = 0.0051) -> DataFrame:
    """topic, rank and what is wrong: another word among the first ``words``, or a weight or a
    prevalence (percentage points) off by more than rounding. No row means the model is the saved one.

    Both: topic, rank, word, weight_pct, prevalence_pct."""
    a, b = saved.where(F.col("rank") <= words).alias("a"), computed.where(F.col("rank") <= words).alias("b")
    both = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("a.rank") == F.col("b.rank")), "full")
    off = lambda c, most: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > most
    wrong = (
        F.when(~F.col("a.word").eqNullSafe(F.col("b.word")), "word")
        .when(F.coalesce(off("weight_pct", weight), F.lit(True)), "weight")
        .when(F.coalesce(off("prevalence_pct", prevalence), F.lit(True)), "prevalence")
    )
    return both.select(F.coalesce("a.topic", "b.topic").alias("topic"), F.coalesce("a.rank", "b.rank").alias("rank"), wrong.alias("wrong")).where("wrong IS NOT NULL")


def fit_grid(docs: DataFrame, ks: tuple[int, ...] = (10, 15, 20, 25), seeds: tuple[int, ...] = (21, 42, 123, 2025, 2026), base_k: int = 15, base_seed: int = 42, passes: int = 30, top: int = 15, workers: int = 8, **vectors) -> DataFrame:
    """Every k with the base seed and every seed with the base k, the shared run once: k, seed,
    log_perplexity, diversity, and of the base run's topics matched with the run's their mean
    and least cosine and mean Jaccard. Runs are submitted ``workers`` at a time, the largest
    first; each is one task, so as many cores are at work."""
    words, rows = vectorised(docs.select("doc_id", "text"), **vectors)
    batches = Minibatches(rows, tasks=1)
    batches.known  # noqa: B018  found once, before the threads ask for it

    def run(task: tuple[int, int]):
        k, seed = task
        return task, *fit_in_a_task(batches, passes, k, len(words), seed)

    tasks = sorted({(k, base_seed) for k in ks} | {(base_k, s) for s in seeds})
    with ThreadPoolExecutor(workers) as pool:
        found = {task: (matrix, score) for task, matrix, score in pool.map(run, sorted(tasks, reverse=True))}
    batches.release()
    out, base = [], found[base_k, base_seed][0]
    for k, seed in tasks:
        matrix, score = found[k, seed]
        pairs = matched_topics(base, matrix, top)
        similar, shared = [p[2] for p in pairs], [p[3] for p in pairs]
        out.append((k, seed, score, diversity(matrix, top), float(np.mean(similar)), float(min(similar)), float(np.mean(shared))))
    return docs.sparkSession.createDataFrame(out, "k int, seed int, log_perplexity double, diversity double, mean_cosine double, least_cosine double, mean_jaccard double")

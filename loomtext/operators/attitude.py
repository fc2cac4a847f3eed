"""Attitude scores: dictionary, character n-grams with logistic regression, semantic axes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import text_of
from ..functions.matching import weighted_count
from ..sources.storage import written
from . import grams
from .ranks import average_ranks, correlation


def dictionary_score(text: Column | str, positive: Mapping[str, float], negative: Mapping[str, float], off_target: Sequence[str], scale: float = 1.5, shrink: float = 0.35) -> Column:
    """score, positive, negative: tanh of the weighted hits' difference over ``scale``, drawn to 0
    the more off-target terms a text holds."""
    text = text_of(text)
    pos, neg = weighted_count(text, positive), weighted_count(text, negative)
    off = weighted_count(text, dict.fromkeys(off_target, 1.0))
    return F.struct((F.tanh((pos - neg) / scale) / (1 + shrink * off)).alias("score"), pos.alias("positive"), neg.alias("negative"))


# --- character n-grams -----------------------------------------------------


def char_grams(text: Column | str, low: int = 2, high: int = 4) -> Column:
    """The n-grams of each word with a space at either side, repeats included; a word that is
    shorter than n has none of it."""
    words = F.filter(F.split(F.lower(text_of(text)), r"(?U)\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column) -> Column:
        sizes = F.sequence(F.lit(low), F.least(F.lit(high), F.length(w)))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))))

    return F.flatten(F.transform(padded, grams))


def char_tfidf(df: DataFrame, row_id: str, text: str, low: int = 2, high: int = 4, min_df: int = 2) -> DataFrame:
    """row_id, gram, weight: logarithmic counts times smoothed inverse document frequency, rows
    of length one; grams of fewer than ``min_df`` rows are left out. Counts stay where they lie
    while the grams are few enough for a broadcast."""
    from .vocabulary import few

    counted = written(df.select(row_id, F.explode(char_grams(text, low, high)).alias("gram")).groupBy(row_id, "gram").agg(F.count(F.lit(1)).alias("tf")), "grams")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    known = counted.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    weight = (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    raw = counted.join(few(known), "gram").crossJoin(F.broadcast(n)).select(row_id, "gram", weight.alias("raw"))  # one row
    own = raw.groupBy(row_id).agg(F.collect_list(F.struct("gram", "raw")).alias("t"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))  # one text's grams
    return own.select(row_id, "norm", F.explode("t").alias("t")).select(row_id, "t.gram", (F.col("t.raw") / F.col("norm")).alias("weight"))


class Fitted(NamedTuple):
    classes: np.ndarray
    alpha: np.ndarray
    bias: np.ndarray

    def probabilities(self, similar: np.ndarray) -> np.ndarray:
        """From the inner products of rows with the training rows."""
        logits = similar @ self.alpha + self.bias
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def balanced_logistic(inner: np.ndarray, labels: np.ndarray, c: float = 1.0, steps: int = 500, tolerance: float = 1e-9) -> Fitted:
    """Multinomial logistic regression with an L2 penalty and classes weighted evenly, on the
    inner products of the training rows: the weights are sums of training rows, so as many
    numbers as rows and classes are fitted, by L-BFGS."""
    classes, y = np.unique(labels, return_inverse=True)
    n, k = len(y), len(classes)
    weight = (n / (k * np.bincount(y)))[y]
    target = np.eye(k)[y]

    def loss(flat):
        a, b = flat[:-k].reshape(n, k), flat[-k:]
        z = inner @ a
        logits = z + b
        top = logits.max(1, keepdims=True)
        log_p = logits - top - np.log(np.exp(logits - top).sum(1, keepdims=True))
        value = -c * (weight * log_p[np.arange(n), y]).sum() + 0.5 * (a * z).sum()
        error = c * weight[:, None] * (np.exp(log_p) - target)
        return value, error + a, error.sum(0), inner @ (error + a)

    # Steps in the space of the weights themselves: the gradient there is X'(error + a).
    flat, memory = np.zeros((n + 1) * k), []
    value, da, db, _ = loss(flat)
    dot = lambda p, q: float((p[:-k].reshape(n, k) * (inner @ q[:-k].reshape(n, k))).sum() + p[-k:] @ q[-k:])
    gradient = np.append(da.reshape(-1), db)
    for _ in range(steps):
        if dot(gradient, gradient) < tolerance**2:
            break
        direction, used = gradient.copy(), []
        for s, q, r in reversed(memory):
            used.append(r * dot(s, direction))
            direction -= used[-1] * q
        if memory:
            s, q, r = memory[-1]
            direction /= r * dot(q, q)
        for (s, q, r), a in zip(memory, reversed(used), strict=True):
            direction += (a - r * dot(q, direction)) * s
        slope, step = dot(gradient, direction), 1.0
        while True:
            fresh, fa, fb, _ = loss(flat - step * direction)
            if fresh <= value - 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        new = np.append(fa.reshape(-1), fb)
        s, q = -step * direction, new - gradient
        curve = dot(s, q)
        if curve > 1e-14:
            memory = [*memory[-9:], (s, q, 1 / curve)]
        flat, value, gradient = flat - step * direction, fresh, new
    return Fitted(classes, flat[:-k].reshape(n, k), flat[-k:])


def _sample(weights: DataFrame, labels: DataFrame, row_id: str, label: str, bound: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The labelled rows (``bound`` at most, by hash of the id) and their weights, on the driver."""
    chosen = labels.where(F.col(label).isNotNull()).select(row_id, F.col(label).cast("int").alias("label")).dropDuplicates([row_id])
    rows = chosen.orderBy(F.xxhash64(row_id), row_id).limit(bound)
    return rows.toPandas().sort_values(row_id).reset_index(drop=True), weights.join(F.broadcast(rows.select(row_id)), row_id).toPandas()


def _matrix(rows: pd.DataFrame, weights: pd.DataFrame, row_id: str) -> tuple[np.ndarray, pd.Index]:
    grams = pd.Index(sorted(weights["gram"].unique()))
    x = np.zeros((len(rows), len(grams)))
    place = {k: i for i, k in enumerate(rows[row_id])}
    x[weights[row_id].map(place).to_numpy(), grams.get_indexer(weights["gram"])] = weights["weight"].to_numpy()
    return x, grams


def gram_logistic_scores(docs: DataFrame, labels: DataFrame, row_id: str, text: str, label: str, c: float = 1.0, tolerance: float = 1e-3) -> DataFrame:
    """row_id, probabilities (by class, ascending), polarity: P(1) - P(-1) (or P(0) without a
    -1). Fitted on every labelled row, with the grams of all rows; of an id with several labels
    the least counts."""
    chosen = labels.where(F.col(label).isNotNull()).groupBy(row_id).agg(F.min(F.col(label).cast("int")).alias("label"))
    texts, repeated = grams.one_text(docs, row_id, text)
    known = grams.known_grams(texts, docs.count())
    model = grams.fitted(texts, known, written(chosen.join(texts.select(row_id), row_id, "left_semi"), "labels"), row_id, c, tolerance)
    scored = grams.probabilities(texts, known, model, row_id)
    if repeated:
        ids = docs.select(F.col(row_id).alias("_id"))
        scored = ids.join(scored, F.col("_id").eqNullSafe(F.col(row_id))).select(row_id, "probabilities")
    against = -1 if -1 in model.classes else 0
    p = lambda x: F.get("probabilities", F.lit(model.classes.index(x))) if x in model.classes else F.lit(0.0)
    return scored.select(row_id, "probabilities", (p(1) - p(against)).alias("polarity"))


def leave_one_out(docs: DataFrame, labels: DataFrame, row_id: str, text: str, label: str, c: float = 1.0, bound: int = 500) -> DataFrame:
    """row_id, label, predicted: each labelled row (``bound`` at most) by a model of all others,
    a row a task at a time. If the others have one class, that is the prediction."""
    rows, own = _sample(char_tfidf(docs, row_id, text), labels, row_id, label, bound)
    x, _ = _matrix(rows, own, row_id)
    spark, y = docs.sparkSession, rows["label"].to_numpy()
    shared = spark.sparkContext.broadcast((x @ x.T, y))  # bound x bound numbers

    def predict(frames):
        inner, y = shared.value
        for frame in frames:
            out = []
            for i in frame["id"]:
                rest = np.delete(np.arange(len(y)), i)
                if len(np.unique(y[rest])) == 1:
                    out.append(int(y[rest][0]))
                    continue
                model = balanced_logistic(inner[np.ix_(rest, rest)], y[rest], c)
                out.append(int(model.classes[model.probabilities(inner[i, rest][None])[0].argmax()]))
            yield pd.DataFrame({"at": frame["id"], "predicted": out})

    parts = min(max(len(y), 1), 4 * spark.sparkContext.defaultParallelism)
    found = spark.range(0, len(y), 1, parts).mapInPandas(predict, "at long, predicted int")
    named = spark.createDataFrame(pd.DataFrame({"at": np.arange(len(y)), row_id: rows[row_id], "label": y}))
    return found.join(F.broadcast(named), "at").select(row_id, "label", "predicted")


# --- scaling by the company of words ---------------------------------------


def word_orientation(counts: DataFrame, polarity: DataFrame, n: int, least: int = 50) -> DataFrame:
    """word, df, orientation: the mean polarity (doc_id, polarity) of the documents that hold a
    word, drawn to 0 the rarer it is; of words in ``least`` documents or more."""
    known = counts.select("doc_id", "word").join(polarity, "doc_id").groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.avg("polarity").alias("mean")).where(F.col("df") >= least)
    return known.select("word", "df", (F.col("mean") * F.least(F.lit(1.0), F.log("df") / F.log(F.lit(float(n))))).alias("orientation"))


def scaled_documents(docs: DataFrame, counts: DataFrame, orientation: DataFrame) -> DataFrame:
    """doc_id, raw (the mean orientation of a document's words, 0 without any) and score, tanh of
    its distance from the corpus's mean in deviations."""
    from .vocabulary import within

    sums = within(counts.select("doc_id", "word", "tf"), orientation).groupBy("doc_id").agg((F.sum(F.col("tf") * F.col("orientation")) / F.sum("tf")).alias("raw"))
    rows = docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    moments = rows.agg(F.avg("raw").alias("m"), F.stddev_samp("raw").alias("s"))
    return rows.crossJoin(F.broadcast(moments)).select("doc_id", "raw", F.tanh((F.col("raw") - F.col("m")) / (F.col("s") + 1e-9)).alias("score"))  # one row


# --- semantic axes ---------------------------------------------------------


class Spec(NamedTuple):
    name: str
    group: str
    removed_positive: str
    removed_negative: str
    min_frequency: int
    aggregation: str


def specifications(positive: Sequence[str], negative: Sequence[str], frequencies: Sequence[int] = (1, 3, 5), baseline: int = 3, aggregations: Sequence[str] = ("mean", "median", "trimmed_mean")) -> list[Spec]:
    """The baseline, every omission of a pair of anchors, the other least frequencies and the
    other ways to aggregate."""
    out = [Spec("baseline", "baseline", "", "", baseline, "mean")]
    out += [Spec(f"drop_{p}_{n}", "anchor_jackknife", p, n, baseline, "mean") for p, n in product(positive, negative)]
    out += [Spec(f"min_freq_{f}", "min_frequency", "", "", f, "mean") for f in frequencies if f != baseline]
    return out + [Spec(a, "aggregation", "", "", baseline, a) for a in aggregations if a != "mean"]


def axis(vectors: Mapping[str, np.ndarray], positive: Sequence[str], negative: Sequence[str]) -> tuple[np.ndarray, float, float]:
    """The unit vector from the mean of the negative anchors to that of the positive ones, and
    the mean and deviation of the anchors' own projections."""
    direction = np.mean([vectors[w] for w in positive], 0) - np.mean([vectors[w] for w in negative], 0)
    direction = direction / (np.linalg.norm(direction) + 1e-12)
    own = np.array([vectors[w] @ direction for w in (*positive, *negative)])
    return direction, float(own.mean()), float(own.std() + 1e-12)


def projected(vector: Column, direction: np.ndarray) -> Column:
    """The inner product with a direction."""
    values = F.array(*[F.lit(float(x)) for x in direction])
    return F.aggregate(F.zip_with(vector, values, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def axis_scores(tokens: DataFrame, vectors: DataFrame, positive: Sequence[str], negative: Sequence[str], specs: Sequence[Spec], row_id: str = "doc_id") -> DataFrame:
    """row_id and a column for each specification: the aggregate of the calibrated scores of the
    row's words (repeats kept) that have a vector and stand often enough; 0 without any.

    tokens: row_id, word; vectors: word, vector (of length one). Only the anchors' vectors
    reach the driver.
    """
    anchors = [*positive, *negative]
    seeds = {r["word"]: np.array(r["vector"], float) for r in vectors.where(F.col("word").isin(anchors)).collect()}
    frequent = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
    known = vectors.join(frequent, "word").where(F.col("frequency") >= min(s.min_frequency for s in specs))
    columns = []
    for i, s in enumerate(specs):
        direction, mean, deviation = axis(seeds, [w for w in positive if w != s.removed_positive], [w for w in negative if w != s.removed_negative])
        score = (projected(F.col("vector").cast("array<double>"), direction) - mean) / deviation
        columns.append(F.when(F.col("frequency") >= s.min_frequency, score).alias(f"s{i}"))
    scored = tokens.select(row_id, "word").join(known.select("word", *columns), "word")

    def aggregate(i: int, how: str) -> Column:
        if how == "mean":
            return F.avg(f"s{i}")
        if how == "median":
            return F.median(f"s{i}")
        values, n = F.array_sort(F.collect_list(f"s{i}")), F.count(f"s{i}")  # one text's words
        cut = F.when(n < 10, 0).otherwise(F.greatest(F.lit(1), F.floor(n * 0.1))).cast("int")
        kept = F.slice(values, cut + 1, (n - 2 * cut).cast("int"))
        return F.when(n > 0, F.aggregate(kept, F.lit(0.0), lambda a, b: a + b) / (n - 2 * cut))

    found = scored.groupBy(row_id).agg(*[aggregate(i, s.aggregation).alias(f"s{i}") for i, s in enumerate(specs)])
    rows = tokens.select(row_id).distinct().join(found, row_id, "left")
    return rows.select(row_id, *[F.coalesce(f"s{i}", F.lit(0.0)).alias(s.name) for i, s in enumerate(specs)])


def specification_summary(scores: DataFrame, specs: Sequence[Spec], source: str, year: str, one: str, other: str) -> DataFrame:
    """For each specification: mean absolute change against the baseline, both sources' means,
    their gap, whether signs hold, and rank correlations with the baseline over rows and over
    the means of source and year (null where a side is constant)."""
    base = specs[0].name
    mean = lambda c, s: F.avg(F.when(F.col(source) == s, F.col(c)))
    sums = [x for s in specs for x in (F.avg(F.abs(F.col(s.name) - F.col(base))).alias(f"change_{s.name}"), mean(s.name, one).alias(f"one_{s.name}"), mean(s.name, other).alias(f"other_{s.name}"))]
    wide = scores.agg(*sums)
    profile = scores.groupBy(source, year).agg(*[F.avg(s.name).alias(s.name) for s in specs])

    def ranked(name: str) -> DataFrame:
        ranks = average_ranks(scores, name).select(F.col(name).alias("_value"), F.col("average_rank").alias(f"_{name}"))
        return scores.join(ranks, F.col(name).eqNullSafe(F.col("_value"))).drop("_value")

    with_base = written(ranked(base), "ranks")

    def over_rows(name: str) -> float | None:
        if name == base:
            return with_base.agg(correlation(f"_{base}", f"_{base}")).first()[0]
        ranks = average_ranks(with_base, name).select(F.col(name).alias("_value"), "average_rank")
        return with_base.join(ranks, F.col(name).eqNullSafe(F.col("_value"))).agg(correlation(f"_{base}", "average_rank")).first()[0]

    means = profile.toPandas()[[s.name for s in specs]].rank()  # a row for each source and year

    def over_profile(name: str) -> float | None:
        x, y = means[base] - means[base].mean(), means[name] - means[name].mean()
        size = float((x * x).sum() * (y * y).sum()) ** 0.5
        return float((x * y).sum()) / size if size > 0 else None

    row = wide.first().asDict()
    sign = lambda x: None if x is None else (x > 0) - (x < 0)
    gap = {s.name: None if row[f"one_{s.name}"] is None or row[f"other_{s.name}"] is None else row[f"one_{s.name}"] - row[f"other_{s.name}"] for s in specs}
    out = [
        (s.name, s.group, s.removed_positive, s.removed_negative, s.min_frequency, s.aggregation, over_rows(s.name), row[f"change_{s.name}"], over_profile(s.name),
         row[f"one_{s.name}"], row[f"other_{s.name}"], gap[s.name], sign(row[f"one_{s.name}"]) == sign(row[f"one_{base}"]), sign(gap[s.name]) == sign(gap[base]))
        for s in specs
    ]
    kinds = "spec string, spec_group string, removed_positive string, removed_negative string, min_frequency int, aggregation string, spearman double, mean_absolute_change double, profile_spearman double, mean_one double, mean_other double, gap double, sign_same boolean, gap_sign_same boolean"
    return scores.sparkSession.createDataFrame(out, kinds)

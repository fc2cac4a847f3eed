"""Term counts and vocabularies: texts are tokenised once, and the counts kept in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .topics import tokenised

#: Vocabularies of at most so many words are broadcast.
BROADCAST_WORDS = 1_000_000


def term_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep``, word, tf of every word of every document."""
    tokens = tokenised(docs.select("doc_id", *keep, "text"))
    return written(tokens.select("doc_id", *keep, F.explode("tokens").alias("word")).groupBy("doc_id", *keep, "word").agg(F.count(F.lit(1)).alias("tf")), "terms")


def vocabulary(counts: DataFrame, min_df: float = 1, max_df: float | None = None, max_features: int | None = None, n: int | None = None) -> DataFrame:
    """word, df, total of the words within the bounds (given as floats, shares of ``n``
    documents); the ``max_features`` most frequent, if asked for."""
    bound = lambda x: x * n if isinstance(x, float) and n is not None else x
    found = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= bound(min_df))
    found = found if max_df is None else found.where(F.col("df") <= bound(max_df))
    return found if max_features is None else found.orderBy(F.desc("total"), "word").limit(max_features)


def few(words: DataFrame) -> DataFrame:
    words = written(words, "vocabulary")
    return F.broadcast(words) if words.count() <= BROADCAST_WORDS else words


def within(counts: DataFrame, words: DataFrame) -> DataFrame:
    """The counts of the words of a vocabulary, with its columns; a frequent word's rows stay
    where they lie while the vocabulary is small enough for a broadcast."""
    return counts.join(few(words), "word")


def mean_tfidf(counts: DataFrame, n: int, min_df: int = 10) -> DataFrame:
    """word, mean_tfidf: smoothed inverse document frequency, rows of length one, mean over all ``n`` documents."""
    raw = F.col("tf") * (F.log((1 + n) / (1 + F.col("df")).cast("double")) + 1)
    weighed = within(counts, vocabulary(counts, min_df)).select("doc_id", "word", raw.alias("v"))
    own = weighed.groupBy("doc_id").agg(F.collect_list(F.struct("word", "v")).alias("t"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))  # one text's words
    return own.select(F.explode("t").alias("t"), "norm").groupBy("t.word").agg((F.sum(F.col("t.v") / F.col("norm")) / n).alias("mean_tfidf"))


def log_odds(counts: DataFrame, first: F.Column, prior: float = 1000.0, least: int = 20) -> DataFrame:
    """word, count_a, count_b, z: log odds of the rows where ``first`` holds against the others,
    with an informative Dirichlet prior of ``prior`` words in all, over their standard error."""
    side = lambda c: F.sum(F.when(c, F.col("tf")).otherwise(0)).cast("double")
    words = counts.groupBy("word").agg(side(first).alias("a"), side(~first).alias("b"))
    sums = words.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    known = words.where(F.col("a") + F.col("b") >= least).crossJoin(F.broadcast(sums))  # one row
    p = prior * (F.col("a") + F.col("b")) / (F.col("na") + F.col("nb"))
    x, y = F.col("a") + p, F.col("b") + p
    z = (F.log(x / (F.col("na") + prior - x)) - F.log(y / (F.col("nb") + prior - y))) / F.sqrt(1 / x + 1 / y)
    return known.select("word", F.col("a").alias("count_a"), F.col("b").alias("count_b"), z.alias("z"))

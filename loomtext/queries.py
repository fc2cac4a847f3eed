"""Queries of the operators that are not plain SQL plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import corpora, ranks, sampling, topics
from .plans.dialect import Portable
from .plans.queries import PLANS, run_plan
from .sources import storage
from .streaming import events

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _lda(spark: SparkSession, sf_dir: str) -> tuple:
    return topics.fit_topics(_docs(spark, sf_dir))


def _perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model, batches = _lda(spark, sf_dir)
    return spark.createDataFrame([(model.log_perplexity(batches),)], "log_perplexity double")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label matched one to one with another label by the cosine of their centroids: the
    greatest sum of cosines of all pairings of the lower half with the upper one."""
    pairs = run_plan(spark, sf_dir, "topic_cosine").collect()  # labels squared
    names = sorted({r.x for r in pairs} | {r.y for r in pairs})
    low, high = names[: len(names) // 2], names[len(names) // 2 :]
    cosine = {(r.x, r.y): r.cosine for r in pairs}
    best = topics.best_assignment([[-cosine[x, y] for y in high] for x in low])
    return spark.createDataFrame([(int(x), int(high[c]), float(cosine[x, high[c]])) for x, c in zip(low, best, strict=True)], "x long, y long, cosine double")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, rank, word, weight of a model by batch variational Bayes: every word within the
    bounds and all 50 passes, as the model of the long texts has them."""
    words, rows = topics.vectorised(_docs(spark, sf_dir).select("doc_id", "text"), 10, 0.5)
    rows = storage.written(rows.where(F.size("ids") > 0), "terms")
    model = topics.BatchLDA(12, len(words)).fit(rows)
    beta = model.components / model.components.sum(1, keepdims=True)
    out = [(t, r + 1, words[w], float(beta[t, w])) for t, top in enumerate(topics.top_words(beta, 10)) for r, w in enumerate(top)]
    return spark.createDataFrame(out, "topic int, rank int, word string, weight double")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labels_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through one file that starts with a byte order mark."""
    df = _table(spark, sf_dir, "labels")
    path = storage.scratch(spark, "csv")
    storage.write_marked_csv(df, path)
    return storage.read_csv(spark, path, df.schema)


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lists of names, each written as a text file of its own."""
    paths = []
    for name, column in (("region", "r_name"), ("nation", "n_name"), ("documents", "lang"), ("documents", "source")):
        paths.append(storage.scratch(spark, "words"))
        _table(spark, sf_dir, name).select(F.coalesce(column, F.lit(""))).distinct().write.text(paths[-1])
    return storage.word_list(spark, paths)


def _standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").withColumn("year", F.col("doc_id") % 5 + 2021)
    pages = _table(spark, sf_dir, "pages").withColumn("published", F.col("page_id") % 5 + 2021)
    return corpora.standardised({"documents": documents, "pages": pages})


def _reasons() -> Column:
    return F.concat_ws("; ", F.when(F.col("value") < 20, "low_value"), F.when(F.col("event_type") == "error", "error_event"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_csv_roundtrip": storage.csv_roundtrip,
    "stratified_sample": lambda s, d: sampling.stratified_sample(_docs(s, d).selectExpr("doc_id", "2021 + doc_id % 5 AS year"), "doc_id", "year", 10),
    "stratified_split": lambda s, d: sampling.stratified_split(s.read.parquet(f"{d}/labels.parquet"), "doc_id", "toxic").select("doc_id", "part"),
    "kfold_assign": lambda s, d: sampling.kfold(s.read.parquet(f"{d}/labels.parquet"), "doc_id", "toxic").select("doc_id", "fold"),
    "topic_word_weights": lambda s, d: topics.topic_words(*_lda(s, d)[:2]),
    "lda_fit": lambda s, d: topics.topic_words(*_lda(s, d)[:2], n=20),
    "lda_fit_batch": _batch,
    "lda_perplexity": _perplexity,
    "hungarian_match": _matched,
    "length_batches": lambda s, d: _docs(s, d).select("doc_id", "n_chars").repartition("doc_id").sortWithinPartitions("n_chars"),
    "summary_struct": lambda s, d: _docs(s, d).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))).alias("summary")),
    "stream_clean": lambda s, d: events.drained(events.clean_items(events.event_stream(s, d), _reasons()).select("event_id", "removal_reason")),
    "stream_posts": lambda s, d: events.drained(events.accepted_posts(events.event_stream(s, d), 7, F.expr("unix_micros(cast(ts as timestamp))"), events.arrival(F.col("event_id")), 50, "event_type", "props", "event_id")).select("event_id", "accepted_as"),
    "stream_dedup": lambda s, d: events.drained(events.first_seen(events.event_stream(s, d), ["user_id", "event_type"])),
    "stream_prefix_earliest": lambda s, d: events.drained(events.earlier_records(events.event_stream(s, d))),
    "stream_quota": lambda s, d: events.drained(events.quota(events.event_stream(s, d))),
    "standardize_corpus": _standardised,
    "lexicon_scan": _lexicon,
    "sink_csv_roundtrip": _labels_csv,
    "lda_grid": lambda s, d: topics.fit_grid(_docs(s, d)),
    "row_ids": lambda s, d: ranks.row_numbers(_docs(s, d).select("source", "doc_id"), "source", "doc_id").select("doc_id", "row_id"),
    "avg_rank": lambda s, d: ranks.with_rank(_table(s, d, "part").select("p_partkey", "p_size"), "p_size", "average_rank").select("p_partkey", "average_rank"),
    "spearman": lambda s, d: ranks.spearman(_table(s, d, "part"), "p_size", "p_retailprice"),
}

_ARRIVAL = "(event_id * 7919) % 1000003"
ORACLES = {
    "scan_csv_roundtrip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "stratified_sample": "SELECT doc_id, year FROM (SELECT doc_id, 2021 + doc_id % 5 AS year, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY md5('42' || doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 10",
    "stratified_split": "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY md5('42' || doc_id::VARCHAR), doc_id) <= floor(count(*) OVER (PARTITION BY toxic) * 0.2::DOUBLE + 0.5) THEN 'validation' ELSE 'train' END AS part FROM labels",
    "kfold_assign": "SELECT doc_id, (row_number() OVER (PARTITION BY toxic ORDER BY md5('42' || doc_id::VARCHAR), doc_id) % 5)::BIGINT AS fold FROM labels",
    "stream_clean": "SELECT event_id, concat_ws('; ', CASE WHEN value < 20 THEN 'low_value' END, CASE WHEN event_type = 'error' THEN 'error_event' END) AS removal_reason FROM events",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_prefix_earliest": f"SELECT event_id FROM (SELECT event_id, ts, min(ts) OVER (PARTITION BY user_id ORDER BY {_ARRIVAL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM events) WHERE low IS NULL OR ts < low",
    "stream_quota": f"SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_ARRIVAL}) AS r FROM events) WHERE r <= 50",
    "standardize_corpus": "SELECT 'documents' AS source, doc_id, text, 2021 + doc_id % 5 AS year FROM documents UNION ALL SELECT 'pages', page_id, html, 2021 + page_id % 5 FROM pages",
    "lexicon_scan": "SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(line), '\\s+')) AS word FROM (SELECT r_name AS line FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT lang FROM documents UNION ALL SELECT source FROM documents) x) y WHERE word <> ''",
    "sink_csv_roundtrip": "SELECT doc_id, quality, toxic FROM labels",
    "length_batches": "SELECT doc_id, n_chars FROM documents",
    "summary_struct": """SELECT '{"n":' || count(*) || ',"chars":' || sum(n_chars) || '}' AS summary FROM documents""",
    **{name: PLANS[name](Portable()) for name in ("row_ids", "avg_rank", "spearman")},
}

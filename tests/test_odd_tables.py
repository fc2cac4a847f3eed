"""Registered queries against their SQL on small tables with what the driver's smallest ones lack."""

import duckdb

import __spark_entry__


def against_sql(spark, folder, name, **tables):
    """The query's rows and its SQL's, both sorted; ``tables`` are written as Parquet by DuckDB."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]}) q").fetchall()
    return sorted(tuple(r) for r in df.select(*columns).collect()), sorted(theirs)


#: Entities without a semicolon, by number, unknown to the SQL, and encoded twice.
PAGES = """SELECT i AS page_id, 'http://x.org/' || i AS url, '<html><title>t' || e || '</title><h1>' || e || '</h1><p>' || e || ' b</p></html>' AS html
    FROM (VALUES (0, 'R&amp'), (1, 'a &amp; b &quot;c&quot;'), (2, '&ampx &copy=1 &lt'), (3, '&#39;d&#x27; &nbsp;&hellip;'), (4, '&amp;lt;i&amp;gt;'), (5, '&lt;i&gt; &middot;&copy;'), (6, '&AMP; &Quot;')) v(i, e)"""


def test_entities_of_clean_html(spark, tmp_path):
    mine, theirs = against_sql(spark, tmp_path, "clean_html", pages=PAGES)
    assert mine == theirs


def test_entities_of_extract_article(spark, tmp_path):
    mine, theirs = against_sql(spark, tmp_path, "extract_article", pages=PAGES)
    assert mine == theirs


def test_entities_of_html_unescape(spark, tmp_path):
    mine, theirs = against_sql(spark, tmp_path, "html_unescape", pages=PAGES)
    assert mine == theirs


#: One arrival for all of a type, ids from the last to the first, each later one older.
TIES = "SELECT 1000003 * i AS event_id, TIMESTAMP '2024-01-01' - i * INTERVAL 1 HOUR AS ts, i % 2 AS user_id, 'view' AS event_type, 1.0 AS value, 'p' AS props FROM range(119, -1, -1) r(i)"


def of_ties(spark, folder, name):
    return [r[0] for r in against_sql(spark, folder, name, events=TIES)[0]]


def test_ties_of_stratum_quota(spark, tmp_path):
    assert of_ties(spark, tmp_path, "stratum_quota") == [1000003 * i for i in range(50)]


def test_ties_of_stream_prefix_earliest(spark, tmp_path):
    assert of_ties(spark, tmp_path, "stream_prefix_earliest") == [1000003 * i for i in range(120)]


def test_ties_of_stream_quota(spark, tmp_path):
    assert of_ties(spark, tmp_path, "stream_quota") == [1000003 * i for i in range(50)]


def test_segments_of_a_large_dictionary():
    """The longest word that isn't all Han wins at each place, and the time doesn't grow with their number."""
    from time import process_time

    from loomtext.functions.segment import Segmenter

    words = [f"w{i:05d}" for i in range(30_000)]
    cutter = Segmenter(dict.fromkeys([*words, "w0000", "研究a", "ing the"], 1), ["mit license"])
    assert cutter.cut("xw00001w0000z 研究ab mit license permit licensed ing thex") == ["xw00001w0000z", " ", "研究a", "b", " ", "mit license", " ", "permit", " ", "licensed", " ", "ing the", "x"]
    text, start = " ".join(["zebra", *words[::-3]]), process_time()
    assert cutter.cut(text)[2::2] == words[::-3] and process_time() - start < 2


def test_batch_of_mixtures():
    """The numbers that documents have one by one, in less than half of the time."""
    from time import process_time

    import numpy as np
    import pyarrow as pa

    from loomtext.operators import topics

    rng = np.random.default_rng(4)
    words = rng.random((12, 400))
    ids = [rng.choice(400, rng.integers(1, 60), replace=False).tolist() for _ in range(300)]
    counts = [rng.integers(1, 5, len(i)).tolist() for i in ids]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], ["ids", "counts"])
    start = process_time()
    alone = [topics.mixture(np.array(i), np.array(c, float), words, 1 / 12) for i, c in zip(ids, counts, strict=True)]
    middle = process_time()
    together = list(topics.mixtures_of(batch, words, 1 / 12))
    assert process_time() - middle < (middle - start) / 2
    assert all(i == a.tolist() and np.allclose(g, x[0], rtol=1e-12) and np.allclose(n, x[1], rtol=1e-12) for i, (a, g, n), x in zip(ids, together, alone, strict=True))


def test_counts_of_grams_stay_where_they_lie(spark):
    from loomtext.operators import attitude

    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa cc")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = attitude.char_tfidf(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_grams_of_odd_texts(spark, tmp_path):
    """Repeated and missing ids and texts, characters of four bytes, words of one; no row for a text and gram."""
    docs = """SELECT i AS doc_id, t AS text FROM (VALUES (1, 'Ab  ab c'), (1, 'abab'), (2, NULL), (3, ''), (4, 'ab 😀b 研究生 研究'), (5, '😀b' || repeat(' abc', 300)), (NULL, 'ab q'), (NULL, 'q'), (6, 'q 研究')) v(i, t)"""
    mine, theirs = against_sql(spark, tmp_path, "char_ngram_tfidf", documents=docs)
    assert [r[:2] for r in mine] == [r[:2] for r in theirs] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(mine, theirs, strict=True))
    assert "Generate" not in __spark_entry__.queries()["char_ngram_tfidf"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_quota_of_negative_ids(spark, tmp_path):
    """Arrivals are those of the SQL, whose remainders have the sign of the id."""
    events = "SELECT (i - 60) * 7 AS event_id, TIMESTAMP '2024-03-10' AS ts, i % 3 AS user_id, 'view' AS event_type, 1.0 AS value, 'p' AS props FROM range(120) r(i)"
    mine, theirs = against_sql(spark, tmp_path, "stream_quota", events=events)
    assert mine == theirs


def test_earliest_of_events_without_a_time(spark, tmp_path):
    events = "SELECT i AS event_id, CASE WHEN i < 9 OR i % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-03-10' + (i * 37 % 120) * INTERVAL 10 MINUTE END AS ts, CASE WHEN i % 4 > 0 THEN i % 4 END AS user_id, 'view' AS event_type, 1.0 AS value, 'p' AS props FROM range(240) r(i)"
    mine, theirs = against_sql(spark, tmp_path, "stream_prefix_earliest", events=events)
    assert mine == theirs

"""Readers, sinks and connectors on small files and recorded replies."""

import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.sources import connectors, readers, sinks, storage


def written(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return f"file://{path}"


def test_marked_headers(spark, tmp_path):
    path = written(tmp_path, "a.csv", '﻿ id , body\n007,"a\nb"\n008,\n')
    df = readers.normalised_headers(spark.createDataFrame([("1", "x")], ["﻿ id ", " body"]))
    assert df.columns == ["id", "body"]
    rows = storage.read_strings(spark, path, ["id", "body"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("007", "a\nb"), ("008", "")]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030"])
def test_encodings(spark, tmp_path, encoding):
    path = written(tmp_path, "a.csv", "id,正文\n1,婚姻登记\n2,中文\n", encoding)
    assert [tuple(r) for r in storage.read_any_encoding(spark, path, ["id", "body"]).orderBy("id").collect()] == [("1", "婚姻登记"), ("2", "中文")]


def test_required_and_aliases(spark):
    df = spark.createDataFrame([(1, "x")], "id long, body string")
    assert readers.required(df, ["id"]) is df and readers.first_present(df, ["text", "body"]) == "body"
    with pytest.raises(ValueError, match="date, title"):
        readers.required(df, ["title", "id", "date"])
    with pytest.raises(ValueError, match="none of the columns"):
        readers.first_present(df, ["text"])


def test_lineage(spark, tmp_path):
    paths = [written(tmp_path, "b.csv", 'id,t\n1,"x\ny"\n2,z\n'), written(tmp_path, "a.csv", "id,t\n3,\n")]
    got = sorted(tuple(r) for r in readers.read_with_lineage(spark, paths, ["id", "t"]).collect())
    assert got == [("1", "x\ny", "b.csv", 1, 2), ("2", "z", "b.csv", 1, 3), ("3", "", "a.csv", 2, 2)]


def test_cache_by_signature(spark, tmp_path):
    df, made = spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string"), []
    def build():
        made.append(1)
        return df.select(F.col("id") * 2)
    sign = readers.signature(df, {"k": 8})
    assert sign == readers.signature(df.orderBy(F.desc("id")), {"k": 8})
    assert len({sign, readers.signature(df, {"k": 9}), readers.signature(df.where("id = 1"), {"k": 8}), readers.signature(df.union(df), {"k": 8})}) == 4
    for _ in range(2):
        assert readers.cached(spark, f"file://{tmp_path}", sign, build).count() == 2
    assert len(made) == 1
    readers.cached(spark, f"file://{tmp_path}", sign + "x", build)
    assert len(made) == 2


def test_settings():
    env = {"N": "5", "E": "", "J": '["a", "", "b"]', "C": "a, b,,c", "S": '"one"'}
    assert (readers.setting_int("N", 1, env), readers.setting_int("E", 1, env), readers.setting_int("X", 2, env)) == (5, 1, 2)
    assert [readers.setting_list(k, ["d"], env) for k in "JCSEX"] == [["a", "b"], ["a", "b", "c"], ["one"], ["d"], ["d"]]


def rows_of(spark, path):
    return sorted(tuple(r) for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("").collect())


def test_replaced_and_appended_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, 'say "x"', "extra")], "id long, t string, more string")
    sinks.replace_csv(df, ["t", "id", "none"], path)
    assert rows_of(spark, path) == [('say "x"', "1", "")]
    with pytest.raises(Exception, match="no good"):
        sinks.replace_csv(df.withColumn("t", F.raise_error(F.lit("no good")).cast("string")), ["t"], path)
    assert rows_of(spark, path) == [('say "x"', "1", "")]
    sinks.replace_csv(df.withColumn("id", F.lit(2)), ["id"], path)
    assert rows_of(spark, path) == [("2",)]
    for _ in range(2):
        sinks.append_csv(df, ["id", "t"], f"{path}-more")
    assert rows_of(spark, f"{path}-more") == [("1", 'say "x"')] * 2


def test_summaries_arrays_splits(spark, tmp_path):
    path = f"file://{tmp_path}"
    sinks.write_summary(spark, {"n": 3, "词": "婚姻"}, f"{path}/s")
    assert sinks.read_summary(spark, f"{path}/s") == {"n": 3, "词": "婚姻"}
    arrays = {"beta": np.arange(6.0).reshape(2, 3), "ids": np.array([3, 1], "<i4")}
    sinks.save_arrays(spark, f"{path}/a", **arrays)
    got = sinks.load_arrays(spark, f"{path}/a")
    assert all(np.array_equal(got[k], v) and got[k].dtype == v.dtype for k, v in arrays.items())
    df = spark.createDataFrame([(i, i % 3, "failed" if i == 4 else "ok") for i in range(9)], "id long, g long, status string")
    sinks.write_splits(df, F.when(F.col("g") == 0, "kept").otherwise("removed"), f"{path}/p")
    assert spark.read.parquet(f"{path}/p/split=kept").count() == 3
    sinks.export_store(df, ["g", "id"], f"{path}/e")
    assert rows_of(spark, f"{path}/e/failures") == [("4", "1", "failed")] and len(rows_of(spark, f"{path}/e/export")) == 9


def read(spark, tmp_path, site, **options):
    spark.dataSource.register(connectors.CandidateSource)
    reader = spark.read.format("candidates").option("site", site.to_json()).option("replies", str(tmp_path))
    for k, v in options.items():
        reader = reader.option(k, json.dumps(v))
    return sorted((r.asDict() for r in reader.load().collect()), key=lambda r: (r["search_keyword"], r["url"]))


def put(tmp_path, body, method="GET", url="http://s.org/q", status=200, **params):
    connectors.record_reply(str(tmp_path), method, url, params, body if isinstance(body, str) else json.dumps(body), status)


def item(n, day, host="a.org"):
    return {"title": f"<b>T{n}</b>", "date": day, "url": f"http://www.{host}/{n}", "content": "c"}


def test_bounded_posts(spark, tmp_path):
    site = connectors.Site("bounded_posts", "M", ["http://dead.org", "http://s.org/q"], rows="data.records", pages=3)
    when = {"startTime": 1609459200000, "endTime": 1640995199000}
    put(tmp_path, "gone", "POST", "http://dead.org", 503, key="k", page=1, **when)
    put(tmp_path, {"data": {"records": [item(1, 1614816000000), item(2, "2020-01-01"), {"title": "no url", "date": "2021-01-01"}]}}, "POST", key="k", page=1, **when)
    put(tmp_path, {"data": {"records": []}}, "POST", key="k", page=2, **when)
    session = connectors.Session(connectors.recorded(str(tmp_path)), sleep=lambda s: None)
    (row,) = connectors.bounded_posts(session, site, "k", 2021)
    assert row == {"media": "M", "search_keyword": "k", "search_title": "T1", "search_date": "2021-03-04", "url": "http://www.a.org/1", "search_content": "c", "study_year": 2021}
    with pytest.raises(connectors.RequestFailed):
        list(connectors.bounded_posts(session, site, "other", 2021))
    live = connectors.Site("bounded_posts", "M", ["http://s.org/q"], rows="data.records", pages=3)
    assert read(spark, tmp_path, live, keywords=["k"], years=[2021]) == [row]


def test_newest_first_stops_before_the_year(spark, tmp_path):
    site = connectors.Site("newest_first", "M", ["http://s.org/q"], hosts=["a.org"], link="web_")
    page = lambda *days: "".join(f"<li><span>{d}</span><a id=web_{i} href='http://r.org/?targetpage=http%3A%2F%2Fwww.a.org%2F{d}'>T {d}</a></li>" for i, d in enumerate(days))
    put(tmp_path, page("2022-01-02", "2021-12-30") + "<li>2021-05-05 <a id=web_9 href='http://b.net/x'>other host</a></li>", q="k", page=1)
    put(tmp_path, page("2021-01-02", "2020-12-30"), q="k", page=2)
    put(tmp_path, page("2021-03-03"), q="k", page=3)
    assert [r["search_date"] for r in read(spark, tmp_path, site, keywords=["k"], years=[2021])] == ["2021-01-02", "2021-12-30"]


def test_archives_and_editions(spark, tmp_path):
    archive = connectors.Site("daily_archive", "D", ["http://s.org/{year}/{month}{day}.html"], link=r"^http://s\.org/news/{year}/\d+$")
    put(tmp_path, "<a href='/news/2021/1'>词 here</a><a href='/news/2021/2'>nothing</a><a href='/ads/3'>词</a><a href='/news/2021/4'>两 词</a>", url="http://s.org/2021/0304.html")
    got = read(spark, tmp_path, archive, keywords=["词", "两"], days=["2021-03-04", "2021-03-05"])
    assert [(r["search_keyword"], r["url"]) for r in got] == [("两|词", "http://s.org/news/2021/4"), ("词", "http://s.org/news/2021/1")]
    paper = connectors.Site("edition", "E", ["http://s.org/{year}-{month}/{day}/p_{page}.htm"], link="art_", plate=r"p_(\d\d)\.htm$")
    base = "http://s.org/2021-03/04/p_"
    put(tmp_path, "<a href='p_02.htm'>2</a><a href='p_03.htm'>3</a><a href='art_1'>词</a>", url=f"{base}01.htm")
    put(tmp_path, "<a href='art_1'>词</a><a href='art_2'>词 two</a>", url=f"{base}02.htm")
    got = read(spark, tmp_path, paper, keywords=["词"], days=["2021-03-04", "2021-03-06"])
    assert [r["url"].rpartition("/")[2] for r in got] == ["art_1", "art_2"]


def test_json_searches(spark, tmp_path):
    down = connectors.Site("descending_api", "J", ["http://s.org/q"], hosts=["a.org"], rows="content")
    put(tmp_path, {"content": [item(1, "2022-01-01"), item(2, "2021-06-01"), item(3, "2021-05-01", "b.org")], "totalPages": 9}, keywords="k", page=0)
    put(tmp_path, {"content": [item(4, "2021-01-01"), item(5, "2020-01-01")]}, keywords="k", page=1)
    put(tmp_path, {"content": [item(6, "2021-01-01")]}, keywords="k", page=2)
    assert [r["url"][-1] for r in read(spark, tmp_path, down, keywords=["k"], years=[2021])] == ["2", "4"]
    ranged = connectors.Site("ranged_api", "R", ["http://s.org/q"], rows="data.data")
    bounds = {"startDate": "2021-01-01", "endDate": "2021-12-31"}
    put(tmp_path, {"data": {"data": [item(1, "2021-02-02")]}}, query="k", pageIndex=0, **bounds)
    put(tmp_path, {"data": None}, query="k", pageIndex=1, **bounds)
    assert [r["search_date"] for r in read(spark, tmp_path, ranged, keywords=["k"], years=[2021])] == ["2021-02-02"]


def test_throttled_discovery():
    site = connectors.Site("discovery", "G", ["http://s.org/q"], hosts=["a.org"], rows="articles")
    replies = [connectors.Reply(200, "Please limit requests"), connectors.Reply(200, json.dumps({"articles": [item(1, "20210304T000000Z"), item(2, "2021-01-01", "b.org")]}))]
    waits: list = []
    session = connectors.Session(lambda *_: replies.pop(0), sleep=waits.append)
    assert [r["url"] for r in connectors.discovery(session, site, "k", 2021)] == ["http://www.a.org/1"] and waits == [6.5]
    with pytest.raises(connectors.RequestFailed):
        list(connectors.discovery(connectors.Session(lambda *_: connectors.Reply(200, "wait"), sleep=waits.append), site, "k", 2021))


def test_sessions_try_again():
    replies, waits = [connectors.Reply(s, "") for s in (429, 503, 200)], []
    assert connectors.Session(lambda *_: replies.pop(0), sleep=waits.append).get("u").status == 200 and waits == [1, 2]
    assert connectors.Session(lambda *_: connectors.Reply(500, ""), tries=2, sleep=waits.append).get("u").status == 500
    assert connectors.candidate("m", "k", None, date(2021, 1, 2), "u", "a  b", 2021)["search_date"] == "2021-01-02"


def test_store(spark, tmp_path):
    from loomtext.sources.store import Store

    crawl = Store(spark, f"file://{tmp_path}/s")
    assert crawl.read("candidates").count() == 0
    rows = lambda xs: spark.createDataFrame(xs, "url string, media string, study_year int")
    crawl.insert("candidates", rows([("u1", "a", 2021), ("u2", "a", 2020), ("u2", "a", 2020), ("u3", "b", 2021)]))
    crawl.insert("candidates", rows([("u1", "other", 2022), ("u4", "c", 2019)]))
    assert {(r.url, r.media) for r in crawl.read("candidates").collect()} == {("u1", "a"), ("u2", "a"), ("u3", "b"), ("u4", "c")}
    status = lambda xs: spark.createDataFrame(xs, "url string, status string")
    crawl.replace("processed", status([("u1", "failed"), ("u2", "done")]))
    crawl.replace("processed", status([("u2", "failed"), ("u3", "done")]))
    assert [r.url for r in crawl.pending().collect()] == ["u4", "u2", "u1"]
    with pytest.raises(Exception, match="lost"):
        crawl.replace("processed", status([("u9", "x")]).withColumn("status", F.raise_error(F.lit("lost")).cast("string")))
    assert {r.url for r in crawl.read("processed").collect()} == {"u1", "u2", "u3"}

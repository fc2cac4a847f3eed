"""Cleaning, matching, dates, rules and segmentation on literal cases."""

import datetime
import html
import random
import re

import pytest
from pyspark.sql import functions as F

from loomtext import lexicons
from loomtext.functions import cleaning, dates, matching, pages, segment
from loomtext.operators import duplicates, rules


def values(spark, texts, *columns):
    """Each expression's value for each text."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r[1:]) for r in rows]


def test_html(spark):
    page = "<p>A&amp;B</p><SCRIPT>var a = '<b>x</b>'; </SCRIPT ><STYLE>p{}</STYLE> see https://x.org/a?b now &lt;script&gt;evil()&lt;/script&gt; <b>c"
    cases = [page, None, "a < b and c", "<p unclosed", "x　\n y&nbsp;z", "<script>if (a) '</b>'</script>t"]
    def plain(t):
        t = html.unescape(t or "")
        for p in (r"<script.*?>.*?</script>", r"<style.*?>.*?</style>"):
            t = re.sub(p, " ", t, flags=re.I | re.S)
        return re.sub(r"\s+", " ", re.sub(r"https?://\S+", " ", re.sub("<[^>]+>", " ", t))).strip()
    assert values(spark, cases, cleaning.clean_html("text")) == [plain(t) for t in cases]
    assert "evil" not in values(spark, [page], cleaning.clean_html("text"))[0]


def test_footers(spark):
    heads = [re.split(r"\[|\.\{", p)[0] for p in lexicons.FOOTERS]
    cases = [f"正文在此。{h}：某某某" for h in heads] + ["正文 责任编辑：张三 来源：某网 " + "长" * 90 + "尾", "正文。版权所有" + "字" * 130 + "完", "正文\n版权所有 甲\n下一行", None, ""]
    def plain(t):
        for p in lexicons.FOOTERS:
            t = re.sub(p, " ", t or "", flags=re.I)
        return re.sub(r"\s+", " ", t or "").strip()
    got = values(spark, cases, cleaning.remove_footers("text"))
    assert got == [plain(t) for t in cases]
    assert len(lexicons.FOOTERS) == 24 and got[:24].count("正文在此。") >= 20 and got[-3] == "正文 下一行"


def test_keys_and_scripts(spark):
    cases = ["《你好》， World—_ ok！", "Привет 你好", "ひらがな", "abc", "123", "", None, "你好かな世界", "é1 ёж"]
    keys, han, other, kana = zip(*values(spark, cases, cleaning.duplicate_key("text"), cleaning.script_only("text"), cleaning.other_letter("text"), cleaning.has_kana("text")), strict=True)
    assert keys[0] == "你好worldok"
    assert han == ("你好", "你好", "", "", "", "", "", "你好世界", "")
    assert other == ("", "П", "ひ", "", "", "", "", "か", "ё")
    assert kana == (False, False, True, False, False, False, False, True, False)
    mixed = ["中" * 200 + "a" * 133, "中" * 200 + "a" * 134, "中" * 199]
    assert values(spark, mixed, cleaning.mainly("text")) == [True, False, False]


def test_formatting(spark):
    cases = ["#话题# 内容 O网页链接", "一个 # 号", "看 www.example.com/a?b=1 和 foo.com/x 以及 a@b.org", "零​宽﻿字", "<b>粗</b> 3 < 4", "头（本条新闻 | 来源\n更多", "发布了头条文章 题", "&lt;i&gt;斜&lt;/i&gt;"]
    got = values(spark, cases, cleaning.clean_formatting("text"))
    assert got == ["话题 内容", "一个 # 号", "看 和 以及", "零宽字", "粗 3 < 4", "头", "题", "斜"]
    assert values(spark, ["#n/a ", "fine"], cleaning.clean_formatting("text", "null")) == [None, "fine"]
    with pytest.raises(Exception, match="error value"):
        values(spark, ["#REF!"], cleaning.clean_formatting("text"))


def test_posts(spark):
    text = "@某人-a 看 #标签# https://t.cn/x L某某的微博视频 网页链接 好"
    assert values(spark, [text, None], cleaning.clean_post("text")) == ["看 标签 好", ""]
    assert values(spark, [text], cleaning.clean_post("text", "#")) == ["看 #标签# 好"]
    assert values(spark, ["看 https://a.b 中<b>文</b>-英 1!"], cleaning.clean_web_text("text")) == ["看 中 文 英 1"]


def test_labels_and_lists(spark):
    cases = ["+1", "1.0", " 1", "-1", "-1.0", "0", "0.0", "U", "NR", "", None]
    assert values(spark, cases, cleaning.normalised_label("text")) == [1, 1, 1, -1, -1, 0, 0, None, None, None, None]
    assert values(spark, ["a; b ;;nan;a", None], cleaning.keyword_list("text")) == ["a|b", ""]


def test_spans_and_gaps(spark):
    rng = random.Random(4)
    cases = ["".join(rng.choice("ab.c") for _ in range(30)) for _ in range(60)] + ["", "aaaa", "aba", "好a好a"]
    terms, others = ["aa", "a.b", "ab", "好a"], ["c", "ba"]
    def plain(t, terms):
        return [(i, i + len(w), w) for w in terms for i in range(len(t)) if t.startswith(w, i)]
    c = F.col("text")
    got = values(spark, cases, matching.spans(c, terms), matching.least_gap(matching.spans(c, terms), matching.spans(c, others)), matching.unique_hits(c, terms), matching.count_of(c, "aa"))
    for t, (found, gap, hits, n) in zip(cases, got, strict=True):
        assert [tuple(s) for s in found] == plain(t, terms)
        gaps = [max(0, max(a, x) - min(b, y)) for a, b, _ in plain(t, terms) for x, y, _ in plain(t, others)]
        assert gap == min(gaps, default=None)
        assert hits == [w for w in terms if w in t] and n == t.count("aa")


def test_dates(spark):
    cases = ["2021年3月4日", "2021/3/4", "2021.03.04 10:00", "http://x.cn/20210304/a.html", "2021-03-04T05:06:07Z", "1999-12-31T23:59:58Z", "2021-13-01", "no date", "", None]
    day = datetime.datetime(2021, 3, 4)
    want = [day, day, day, day, day, datetime.datetime(1999, 12, 31, 23, 59, 58), None, None, None, None]
    assert values(spark, cases, dates.parse_date(F.col("text"))) == want
    assert [pages.date_in(t) for t in cases] == want
    numbers = [1614816000.0, 1614816000000.0]
    got = spark.createDataFrame([(n,) for n in numbers], "n double").select(dates.parse_epoch(F.col("n")).alias("t")).collect()
    assert [r.t for r in got] == [day, day] == [pages.date_in(n) for n in numbers]
    years = ["3/4/2021 5:06", "2022-01-01", "none", None]
    fb = F.lit("2019 or 2020")
    assert values(spark, years, dates.year_of(F.col("text"), fb)) == ["2021", "2022", "2019", "2019"]
    assert values(spark, years, dates.year_of(F.col("text"), F.lit("x 2020"), True)) == ["2021", "2022", "2020", "2020"]
    assert values(spark, years, dates.year_of(F.col("text"), F.lit("none"), True)) == ["2021", "2022", "", ""]


@pytest.mark.parametrize("last, want", [("01-10", [("01-01", "01-05"), ("01-06", "01-10")]), ("01-11", [("01-01", "01-05"), ("01-06", "01-11")]), ("01-03", [("01-01", "01-03")])])
def test_blocks(spark, last, want):
    rows = dates.day_blocks(dates.calendar(spark, "2024-01-01", f"2024-{last}")).orderBy("block_start").collect()
    assert [(str(r.block_start)[5:], str(r.block_end)[5:]) for r in rows] == want
    month = dates.month_bounds(dates.calendar(spark, "2024-02-03", "2024-02-05")).first()
    assert (month.month, str(month.month_start), str(month.month_end)) == ("2024-02", "2024-02-01", "2024-02-29")


def test_quality_gate(spark):
    rows = [("", "d", "t" * 60), ("m", " ", "t" * 60), ("m", "d", None), ("m", "d", "t" * 49), ("m", "d", "t" * 50)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, m string, d string, t string").orderBy("i").select(rules.data_quality("m", "d", "t").alias("q")).collect()
    assert [r.q for r in got] == ["missing_media", "missing_date", "missing_text", "text_too_short", "valid"]


def test_contexts(spark):
    cases = ["他找对象，也是研究对象", "无关", "对象而已", "服务对象", "相亲对象"]
    assert values(spark, cases, rules.keyword_context("text")) == ["non_romantic", "no_object", "ambiguous", "non_romantic", "romantic"]
    assert values(spark, cases, rules.keyword_context("text", partner_first=True)) == ["romantic", "no_object", "ambiguous", "non_romantic", "romantic"]


def test_article_relevance(spark):
    rows = [("彩礼", "x"), ("题", "彩礼"), ("题", "彩礼 单身"), ("题", "婚姻登记"), ("题", "对象"), ("对象父母", "y"), ("题", "研究对象 单身"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a string, b string").orderBy("i")
    got = [tuple(r.r) for r in df.select(rules.article_relevance("a", "b").alias("r")).collect()]
    assert got == [
        ("highly_relevant", "彩礼", "彩礼"), ("manual_review", "彩礼", ""), ("highly_relevant", "单身;彩礼", ""), ("highly_relevant", "婚姻;婚姻登记", ""),
        ("not_relevant", "", ""), ("highly_relevant", "对象", "对象"), ("manual_review", "单身", ""), ("not_relevant", "", ""),
    ]


def test_post_relevance(spark):
    cases = {
        "我们的婚姻": "A_strong_keyword",
        "研究对象": "F_fixed_ambiguous_expression",
        "单身" + "字" * 20 + "夫妻": "B_weak_near_context",
        "单身" + "字" * 21 + "夫妻": "borderline_weak_context_far",
        "恋爱观": "B_weak_near_context",
        "我觉得单身": "C_personal_attitude",
        "单身 x 相亲": "D_multiple_weak_keywords",
        "我单身": "borderline_partial_personal_evidence",
        "单身": "E_single_unsupported_weak_keyword",
        "ai伴侣 单身": "F_fixed_ambiguous_expression",
        "天气": "no_project_keyword",
        "": "no_project_keyword",
    }
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(cases)], "i long, body string, level string")
    got = rules.post_relevance(df, "body").orderBy("i").collect()
    assert [r.relevance_rule for r in got] == list(cases.values())
    assert [r.weak_context_min_gap for r in got[2:5]] == [20, 21, 0]
    assert got[4].matched_weak_terms == ["恋爱"] and got[4].matched_context_terms == ["恋爱观"] and got[9].matched_ambiguous_patterns == ["AI伴侣"]
    assert got[3].relevance_exclusion_reason == "weak_context_gap_over_20" and got[0].level == "mine"


def test_cleaning_reasons(spark):
    rows = [("", "k"), ("正文", "词"), ("小说TXT 超话 Anna Привет", "小说"), ("abc", ""), ("好好的", None), ("ANNA 好", "好")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, b string, k string").orderBy("i")
    got = [r.r for r in df.select(rules.cleaning_reasons("b", "k", names=["anna"]).alias("r")).collect()]
    assert got == [
        "blank_body; query_keyword_not_in_body:k", "query_keyword_not_in_body:词", "fiction_term:小说; excluded_term:超话; celebrity_name:Anna; other_script:П",
        "no_han_characters", "", "celebrity_name:ANNA",
    ]


def test_acceptance(spark):
    rows = [(2019, "k" * 300), (2021, "k" * 199), (2021, "x" * 300), (2021, "k" * 300), (None, "k" * 300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, y int, t string").orderBy("i")
    got = [r.r for r in df.select(rules.acceptance(F.col("y"), 2020, 2022, "t", ["k"]).alias("r")).collect()]
    assert got == ["outside_year", "too_short", "no_keyword", "retained", "outside_year"]
    assert [r.r for r in df.select(rules.acceptance(F.col("y"), 2020, 2022, "t", ["k"], script=cleaning.mainly("t")).alias("r")).collect()][3] == "not_mainly_chinese"


def test_keep_first(spark):
    rows = [(1, "k", None, "f1"), (2, "k", 5, "f2"), (3, "k", 5, "f1"), (4, "alone", 1, "f"), (5, None, 2, "f"), (6, None, 1, "f")]
    df = spark.createDataFrame(rows, "id long, key string, at long, file string")
    kept, removed = duplicates.keep_first(df, F.col("key"), ["at", "file"], "id")
    assert {r.id for r in kept.collect()} == {3, 4, 6}
    assert {(r.id, r.retained_id, r.retained_at) for r in removed.collect()} == {(1, 3, 5), (2, 3, 5), (5, 6, 1)}
    meta = {r.duplicate_group_size: r.files for r in duplicates.group_metadata(df, F.col("key"), {"files": F.col("file")}).collect()}
    assert meta[3] == '["f1","f2"]'


def test_reprints(spark):
    rows = [(1, "a", "T", "x"), (2, "b", "t!", "y"), (3, "c", "other", "y"), (4, "c", "more", "z"), (5, "c", "More.", "w"), (6, "d", "", ""), (7, "e", None, ""), (8, "a", "s", "q"), (9, "b", "r", "Q")]
    df = spark.createDataFrame(rows, "id long, media string, title string, text string")
    got = {r.id: tuple(r[1:]) for r in duplicates.reprints(df, "id", "media", F.col("title"), F.col("text")).collect()}
    assert got[1] == (False, True, "same_title") and got[2] == (False, True, "same_text") and got[3] == (False, True, "same_text")
    assert got[4] == got[5] == (True, False, "") and got[6] == got[7] == (False, False, "") and got[8] == got[9] == (False, True, "same_text")


def test_candidates(spark):
    rows = [("u", "b|a", "m1", 2), ("u", "c|a", "m2", 1), ("v", None, "m3", 1)]
    df = spark.createDataFrame(rows, "url string, words string, media string, at long")
    got = {r.url: (r.words, r.media) for r in duplicates.merged_candidates(df, "url", "words", ["media"], "at").collect()}
    assert got == {"u": ("a|b|c", "m2"), "v": ("", "m3")}


def test_segments():
    counts = {"研究": 50, "研究生": 20, "生命": 40, "命": 10, "起源": 30, "的": 500, "生": 5}
    cut = segment.Segmenter(counts).cut
    assert cut("研究生命的起源") == ["研究", "生命", "的", "起源"]
    assert cut("研究生") == ["研究生"] and cut("龘龘") == ["龘", "龘"]
    assert cut("共12.5%，ok！") == ["共", "12.5%", "，", "ok", "！"]
    assert segment.Segmenter(counts, ["研究生命的", "AI伴侣"]).cut("研究生命的起源AI伴侣") == ["研究生命的", "起源", "AI伴侣"]


def test_segments_by_brute_force():
    rng = random.Random(6)
    counts = {"".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 3))): rng.randint(1, 90) for _ in range(30)}
    cutter = segment.Segmenter(counts)
    def cost(words):
        return sum(cutter.cost.get(w, cutter.alone) if len(w) == 1 else cutter.cost.get(w, 1e9) for w in words)
    def cuts(t):
        return [[]] if not t else [[t[:i], *rest] for i in range(1, min(3, len(t)) + 1) for rest in cuts(t[i:])]
    for _ in range(60):
        t = "".join(rng.choice("甲乙丙丁") for _ in range(9))
        assert cost(cutter.cut(t)) == pytest.approx(min(cost(c) for c in cuts(t)))


def test_tokens(spark):
    words = ["12", "5%", "12w", "JPG", "hhhh", "哈哈哈", "婚", "好", "的确", "stop", "P12", "，", "a", "em", "emm", "Ok"]
    df = spark.createDataFrame([(words,)], "w array<string>")
    assert df.select(segment.kept_tokens(F.col("w"), ["stop"], ["婚"]).alias("k")).first().k == ["婚", "的确", "em", "ok"]
    docs = spark.createDataFrame([("题", "研究生命 12 #标签#"), (None, None)], "t string, x string")
    got = segment.analysed(docs, "x", {"研究": 5, "生命": 5, "标签": 5}, title="t").orderBy(F.col("token_count").desc()).collect()
    assert (got[0].analysis_text, got[0].tokens, got[0].token_count) == ("题。研究生命 12 标签", "研究 生命 标签", 3) and got[1].token_count == 0


PAGE = """<html><head><title>Site</title><meta property='article:published_time' content='2021-03-04T10:00:00Z'></head>
<body><nav><p>navigation that is long enough to count as text</p></nav><h1></h1>
<div class='x content'><p>short</p><p>{0}</p><script>p('<p>no</p>')</script><p>{0} again</p></div><article><p>a smaller block of text here</p></article></body></html>"""


def test_articles(spark):
    long = "A paragraph that is long enough to be an article's text, with some more words so that it counts as one."
    got = pages.extract(PAGE.format(long))
    assert got["title"] == "Site" and got["date"] == datetime.datetime(2021, 3, 4)
    assert got["text"] == f"{long}\n{long} again"
    assert pages.extract("<p>tiny</p>", title="<b>given</b> title", snippet="the snippet") == {"title": "given title", "date": None, "text": "the snippet"}
    assert pages.extract(f"<div id=ozoom><p>{long * 3}</p></div><article><p>{long * 9}</p></article>", edition=True)["text"] == long * 3
    rows = [(1, "http://x.org/20210405/a", PAGE.format(long)), (2, None, None)]
    got = {r.page_id: r for r in pages.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].published == datetime.datetime(2021, 4, 5) and got[1].text.endswith("again") and got[2].text == ""


def test_dates_near_links():
    root = pages.parsed("<div><ul><li><span>2021-05-06</span><p><a href=x>one</a></p></li><li><a href=y>two 2022年1月2日</a></li></ul></div><a href=z>three</a>")
    found = [pages.date_near(a) for a in root.elements("a")]
    assert found[:2] == [datetime.datetime(2021, 5, 6), datetime.datetime(2022, 1, 2)]
    deep = pages.parsed("<div>2020-01-01" + "<i>" * 6 + "<a>x</a>" + "</i>" * 6 + "</div>")
    assert pages.date_near(next(deep.elements("a"))) is None


def test_addresses(spark):
    base = "https://a.org/x/y.html?page=2&q=%E5%A9%9A%20z#top"
    links = ["http://b.net/k", "//c.org/k", "/root?i=1", "beside.html", "?page=3", "#end", "mailto:a@b.org"]
    want = ["http://b.net/k", "https://c.org/k", "https://a.org/root?i=1", "https://a.org/x/beside.html", "https://a.org/x/y.html?page=3", "https://a.org/x/y.html?page=2&q=%E5%A9%9A%20z#end", "mailto:a@b.org"]
    assert values(spark, links, matching.url_join(F.lit(base), F.col("text"))) == want
    assert values(spark, ["q", "none"], F.coalesce(matching.url_parameter(F.lit(base), "q"), F.lit("-"))) == ["婚 z"] * 2
    assert values(spark, ["https://a.org"], matching.url_join(F.col("text"), F.lit("k"))) == ["https://a.org/k"]


def test_python_functions_over_tables(spark):
    from loomtext.functions import udf

    df = spark.createDataFrame([(1, "a", 2.0), (2, None, 4.0), (3, "a", 7.0)], "id long, g string, x double")
    assert [r.g for r in udf.apply_column(df, "g", lambda v: (v or "none") * 2, "string").orderBy("id").collect()] == ["aa", "nonenone", "aa"]
    rows = udf.apply_rows(df, lambda r: {"twice": r["x"] * 2, "tag": f"{r['id']}"}, "twice double, tag string").orderBy("id").collect()
    assert [(r.x, r.twice, r.tag) for r in rows] == [(2.0, 4.0, "1"), (4.0, 8.0, "2"), (7.0, 14.0, "3")]
    got = udf.aggregate_groups(df, ["g"], {"spread": ("x", lambda v: v.max() - v.min()), "all": ("id", lambda v: "-".join(map(str, v)))}, {"spread": "double", "all": "string"})
    assert {r.g: (r.spread, r["all"]) for r in got.collect()} == {"a": (5.0, "1-3"), None: (0.0, "2")}

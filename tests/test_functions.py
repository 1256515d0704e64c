"""Edge cases of the column expressions."""

import datetime as dt

from pyspark.sql import functions as F

from tidewire.functions import dates, text, web


def values(spark, inputs, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_clean_text(spark):
    got = values(spark, ["&lt;b&gt;Bold&lt;/b&gt; a 　b", None, "<script>var a='</p>';</script>left", "x &amp;amp; y", "Body The post Title appeared first on Site."], text.clean_text)
    assert got == ["Bold a b", "", "left", "x &amp; y", "Body"]


def test_clip(spark):
    assert values(spark, ["abcdef", "abc, ef", "abc"], lambda c: text.clip(c, 5)) == ["abcd…", "abc…", "abc"]


def test_titles(spark):
    assert values(spark, ["The US sues OpenAI over GPT-5", "中 文字 大模型"], text.title_tokens) == [["gpt-5", "lawsuit", "openai"], ["大模型", "文字"]]
    assert values(spark, ["NATO and UAV-2 at EU"], text.acronyms) == [["nato", "uav-2"]]
    assert values(spark, ["Ab-C 大!"], text.normalized_title) == ["abc大"]


def test_history_tokens(spark):
    assert values(spark, ["技术", "空间站发射 v2 3.5 report", "卫星"], text.history_tokens) == [[], ["2", "3.5", "发射", "空间", "站发", "间站"], ["卫星"]]


def test_keywords(spark):
    assert values(spark, ["chips", "a chip.", "(cca)", "无人机群"], lambda c: text.keyword_matches(c, "chip") | text.keyword_matches(c, "cca") | text.keyword_matches(c, "无人机")) == [False, True, True, True]
    assert values(spark, ["c++ rocks"], lambda c: text.keyword_matches(c, "c++")) == [True]


def test_urls(spark):
    got = values(spark, ["HTTPS://WWW.A.com//b//c/?utm_source=x&Q=1&ref=r&z#f", None, "http://a.com/", "http://a.com/x?output=1"], web.canonical_url)
    assert got == ["https://www.a.com/b/c?Q=1&z=", "", "http://a.com", "http://a.com/x"]
    assert values(spark, ["http://WWW.A.com:80/x", None], web.domain) == ["a.com:80", ""]


def test_ids(spark):
    df = spark.createDataFrame([("http://a.com/x#1", "T"), ("http://a.com/x", "U"), (None, "Same"), ("", "same")], "u string, t string")
    a, b, c, d = (r[0] for r in df.select(web.article_id(F.col("u"), F.col("t"))).collect())
    assert a == b and c == d and len(a) == 14


def test_dates(spark):
    got = values(spark, ["2026-07-15T22:30:00Z", "Thu, 30 Jul 2026 17:13:13 +0200", "20260721T054824Z", "2026-07-17T07:21:40+09:00", "2026-07-24 02:28:36", "2026-07-15", "n/a", "0000-00-00", None, "20260721054824", "30 Jul 2026 17:13:13 GMT"], dates.parse)
    d = dt.datetime
    assert got == [d(2026, 7, 15, 22, 30), d(2026, 7, 30, 15, 13, 13), d(2026, 7, 21, 5, 48, 24), d(2026, 7, 16, 22, 21, 40), d(2026, 7, 24, 2, 28, 36), d(2026, 7, 15), None, None, None, d(2026, 7, 21, 5, 48, 24), d(2026, 7, 30, 17, 13, 13)]


def test_wire(spark):
    df = spark.createDataFrame([("x.reuters.com", "", ""), ("", "AP", ""), ("a.b", "z", "LONDON (Reuters) - x"), ("a.b", "z", "an ap story"), ("a.b", "z", "(AP) story")], "d string, s string, t string")
    assert [r[0] for r in df.select(web.wire_family(F.col("d"), F.col("s"), F.col("t"))).collect()] == ["wire:reuters", "wire:ap", "wire:reuters", "", "wire:ap"]

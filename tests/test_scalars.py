"""Golden values of the URL, text and routing functions."""

import pytest
from pyspark.sql import functions as F

from chapterlake.functions import text, urls
from chapterlake.operators import routing


def many(spark, rows, f):
    """Values of f over rows of strings."""
    width = len(rows[0])
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"c{i} string" for i in range(width)))
    return [r["r"] for r in df.select("k", f(*[F.col(f"c{i}") for i in range(width)]).alias("r")).orderBy("k").collect()]


def test_access(spark):
    hosts = ["http://localhost/", "https://a.test/x", "http://10.1.2.3:8/", "http://172.32.0.1/", "http://[::1]/", "ftp://localhost/", "http://novel.site/", None]
    got = many(spark, [(h,) for h in hosts], urls.access_decision)
    assert [g == "local_or_test_url" for g in got] == [True, True, True, False, True, False, False, False]


def test_final_url(spark):
    rows = [("http://h/a/%41?x=1", "http://H./a/A?x=1"), ("http://h/a", "http://h/b"), ("http://h/a?x", "http://h/a"), (None, "http://h/")]
    assert many(spark, rows, urls.final_url_error) == [None] + ["chapter_redirect_mismatch"] * 3


def test_sibling_templates(spark):
    rows = [("/b/ch-1.html", "/b/ch-2.html"), ("/b/1/2", "/b/2/3"), ("/b/1", "/b/1"), ("/b/a1", "/b/b2"), ("/b/1-1", "/b/2-2"), ("/b/1", "/b/1/2"), (None, "/b")]
    assert many(spark, rows, urls.sibling_template) == ["/b/ch-{int}.html", None, None, None, None, None, None]


def test_patterns(spark):
    rows = [
        ("https://h.com/book/12", "/book/{int}"), ("https://h.com/book/x-1", "/book/{slug}"), ("https://h.com/book/1/2/3", "/book/**"), ("https://h.com/book/1/2", "/book/*"),
        ("https://h.com/ch-9.html", "/ch-{int}.html"), ("https://h.com/ch-9xhtml", "/ch-{int}.html"), ("https://h.com/a", "https://h.com/a"), ("https://h.com/a", "/**/a"), (None, "/a"),
    ]
    assert many(spark, rows, urls.pattern_matches) == [True, True, True, False, True, False, True, False, False]


def test_lines(spark):
    assert many(spark, [("请收藏本站，正文。最新网址：www.a.com，继续",)], text.drop_promotions) == ["正文。继续"]
    assert many(spark, [("一\n上一章\n章节错误，点此\n二",)], lambda c: text.drop_lines(c, ("章节错误",), ("上一章", "目录"))) == ["一\n二"]


def test_link_numbers(spark):
    rows = [("Chapter 12", "/x/3"), ("第 4 章", "/9"), ("Chapter 1.5", "/c/8"), ("Prologue", "/c/1"), ("Book 2", "/c/7"), ("第一章", "/c/5"), ("", "/c/")]
    assert many(spark, rows, text.link_number) == [12, 4, 8, None, None, 5, None]


def test_authors(spark):
    assert many(spark, [("作者：张三",), ("By  Ann Lee",), ("Author: X",), ("nothing",), (None,)], text.author_of) == ["张三", "Ann Lee", "X", None, None]


def test_subtitles(spark):
    srt = "1\n00:00:00,000 --> 00:00:01,500\nhi\nthere\n\nbad\n\n2\n00:00:02,000 --> 00:00:03,000\nyou\n"
    got = many(spark, [(srt,)], text.srt_blocks)[0]
    assert [(b["index"], b["start"], b["end"], b["text"]) for b in got] == [(1, 0.0, 1.5, "hi\nthere"), (2, 2.0, 3.0, "you")]


def test_sensitive(spark):
    rows = [("Authorization: Bearer abc",), ("password = hunter2",), ('{"token": "x"}',), ("Cookie: a=b",), ("<body>",), ("profile path: /x",), ("see bearer abcdef1",), ("plain story",), ("a token: gold",)]
    got = many(spark, rows, text.sensitive_hits)
    assert [len(g) > 0 for g in got] == [True] * 7 + [False, True]
    assert many(spark, [("The Cookie: Sweet",), ("secret: sk-Abc",)], lambda c: text.sensitive_hits(c, True)) == [[], ["credential_colon"]]
    assert many(spark, [("My-API key",), ("title",)], text.sensitive_key) == [True, False]


def test_safe_values(spark):
    assert many(spark, [("a story",), ("see https://x",), ("a\x01",), (None,), ("C:\\x\\y",)], text.redact) == ["a story"] + ["[redacted]"] * 4
    assert many(spark, [("parse_failed",), ("odd",), (None,)], text.safe_error_code) == ["parse_failed", "chapter_download_failed", "chapter_download_failed"]
    stamps = [("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05",), ("2024-13-02T03:04:05Z",), (None,)]
    assert many(spark, stamps, text.safe_timestamp) == ["2024-01-02T03:04:05Z", None, None, None]
    assert many(spark, [("-4",), ("7",), (None,), ("9999999999",)], lambda c: text.safe_count(c.cast("long"))) == [0, 7, 0, 2_147_483_647]


def test_chapter_errors(spark):
    rows = [("", "第2章 x", "b"), ("第1章", "第2章 x", "b"), ("own", "第2章 x", "b"), ("", "第1章", "b"), ("", "x", " "), (None, "第一章", "b")]
    assert many(spark, rows, lambda s, t, b: text.chapter_error(F.lit(1), s, t, b)) == ["chapter_title_mismatch", "chapter_title_mismatch", None, None, "chapter_content_empty", None]


def test_routes(spark):
    rows = [("http://www.twbook.cc/12/3.html",), ("https://shuyous.com/book/5-6-2.html",), ("https://bqg12.cc/x/book/9/",), ("https://a.novel.site/1",), (None,)]
    df = spark.createDataFrame([(k, u) for k, (u,) in enumerate(rows)], "k int, url string")
    got = [tuple(r)[2:] for r in routing.url_parts(df).orderBy("k").collect()]
    assert got == [("twbook", "12", 3, None), ("shuyous", "5", 6, 2), ("bqg", "9", None, None), ("auto", None, None, None), ("auto", None, None, None)]
    assert many(spark, [("http://a.novel.site/1",)], lambda c: routing.site_of(c, suffixes={"novel.site": "mine"})) == ["mine"]


def test_sequential_urls(spark):
    books = spark.createDataFrame([(7, "http://h/7/", 3, 2), (8, "http://h/8/", 1, 0)], "book_id long, url string, start long, count long")
    assert [(r["index"], r["url"]) for r in routing.sequential_urls(books).orderBy("index").collect()] == [(3, "http://h/7/3.html"), (4, "http://h/7/4.html")]


@pytest.mark.parametrize("value", [None, ""])
def test_nulls_and_blanks(spark, value):
    for f in (text.drop_promotions, text.srt_blocks, text.sensitive_hits, text.author_of, urls.pattern_regex, lambda c: urls.sibling_template(c, c)):
        many(spark, [(value,)], f)

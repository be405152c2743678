import time

from pyspark.sql import functions as F

from chapterlake.functions import text, urls


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_numerals(spark):
    cases = {"123": 123, "一": 1, "十": 10, "二十": 20, "一百二十三": 123, "两千零一": 2001, "甲": -1}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", text.numeral(F.col("v")).alias("n")).collect()
    assert {r["v"]: r["n"] for r in rows} == cases


def test_fix_title(spark):
    assert one(spark, "第5章 错误", lambda c: text.fix_title(F.lit(1), c)) == "第1章 错误"
    assert one(spark, "", lambda c: text.fix_title(F.lit(3), c)) == "第3章"
    assert one(spark, "序章", lambda c: text.fix_title(F.lit(3), c)) == "序章"


def test_chapter_parts(spark):
    assert one(spark, "T\n\nB\nC", text.chapter_title) == "T" and one(spark, "T\n\nB\nC", text.chapter_body) == "B\nC"
    assert one(spark, " only ", text.chapter_title) == "only" and one(spark, " only ", text.chapter_body) == ""


def test_names_and_stamps(spark):
    assert one(spark, 'a/b:"c" ', text.safe_filename) == "a_b_c" and one(spark, "///", text.safe_filename) == "untitled"
    assert one(spark, "01:02:03,500", text.srt_seconds) == 3723.5
    assert one(spark, "x", lambda c: text.srt_timestamp(F.lit(3723.5))) == "01:02:03,500"


def test_canonical_urls(spark):
    cases = {
        "HTTPS://b.Example:443/a/../c?q=two%20words&a=1#part": "https://b.example/c?q=two%20words&a=1",
        "https://b.example/1?a=1&a=2&X-Signature=%7e%2f#f": "https://b.example/1?a=1&a=2&X-Signature=~%2F",
        "https://b.example/1?flag&empty=&q=a+b&&raw=%41%2f": "https://b.example/1?flag&empty=&q=a+b&&raw=A%2F",
        "https://b.example/1?bad=%ZZ": None,
        "https://user:secret@b.example/": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", urls.canonical_url(F.col("v")).alias("u")).collect()
    assert {r["v"]: r["u"] for r in rows} == cases


def test_templates_and_references(spark):
    assert one(spark, "/book/12/the-end", urls.path_template) == "/book/{int}/{slug}"
    assert one(spark, "../x", lambda c: urls.resolve(F.lit("http://h/a/b"), c)) == "http://h/a/../x"
    assert one(spark, "?p=2", lambda c: urls.resolve(F.lit("http://h/a/b"), c)) == "http://h/a/b?p=2"


def test_plain_urls_are_their_own_canonical_form_at_little_cost(spark):
    heads = ["http://a.test", "https://a-b.c9.test", "HTTP://a.test", "http://A.test", "http://a.test.", "http://a..b", "http://u@a.test", "http://a.test:80", "http://a.test:8080", "ftp://a.test", "http://", "http:///", "http://é.test", "http://a_b.test", "//a.test", f"http://{'a' * 60}.{'b' * 60}.{'c' * 60}.{'d' * 80}"]
    tails = ["", "/", "//", "/a", "/a/", "/a/b-c_d~e.html", "/.", "/..", "/a/..", "/a/../", "/.../", "/a/./b", "/..a/b", "/a//b", "/%41", "/%zz", "/é", "/a b", "/a\n", "/a\t", "/a?", "/a?b=c", "/a#b", "/a+b", "/a;b", "/" + "a" * 300]
    rows = spark.createDataFrame([(h + t,) for h in heads for t in tails] + [(None,)], "u string")
    got = rows.select("u", urls.canonical_url(F.col("u")).alias("a"), urls._resolved_url(F.col("u")).alias("b")).collect()
    assert [r for r in got if r["a"] != r["b"]] == [] and sum(r["a"] is not None and r["a"] == r["u"] for r in got) > 10

    def seconds(made):
        made = spark.range(0, 40_000, 1, 4).select(urls.canonical_url(F.concat(F.lit("http://shelf.test/"), F.col("id").cast("string"))).alias("u") if made else urls._resolved_url(F.concat(F.lit("http://shelf.test/"), F.col("id").cast("string"))).alias("u"))
        made.agg(F.max("u")).collect()
        at = time.perf_counter()
        made.agg(F.max("u")).collect()
        return time.perf_counter() - at

    assert seconds(True) * 2 < seconds(False)

import random
from datetime import datetime, timezone
from decimal import Decimal
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chapterlake.operators import books, dedup, dom, events, extract, pages
from chapterlake.plans import admin_queries, queries, site_queries, text_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
SLOW = {"similar_pairs", "approximate_pairs"}


def plain(row):
    """A row as text, its fractions to nine digits, its times in UTC."""
    value = lambda v: round(float(v), 9) if isinstance(v, (float, Decimal)) else v.astimezone(timezone.utc).replace(tzinfo=None) if isinstance(v, datetime) and v.tzinfo else v
    return repr([value(v) for v in row])


@pytest.mark.parametrize("name", sorted(set(queries.SQL) - SLOW))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "customer orders lineitem events documents pages labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted(plain([r[c] for c in columns]) for r in got.collect())
    wanted = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.SQL[name]})").fetchall()
    assert len(mine) == len(wanted)
    assert mine == sorted(plain(r) for r in wanted)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_similar_pairs_equal_brute_force(spark):
    rows = [("b", k, t) for k, t in enumerate(["the quick brown fox jumps over it", "the quick brown fox jumps over it!", "nothing alike at all here", "x", "x", ""])]
    chapters = spark.createDataFrame(rows, "book_id string, chapter_index int, body string")
    assert [(r["a"], r["b"]) for r in dedup.similar_pairs(chapters).collect()] == [(0, 1)]
    assert [(r["first_index"], r["chapter_index"]) for r in dedup.exact_duplicates(chapters).collect()] == [(3, 4)]


def test_audit(spark):
    rows = [("t", 0, "created"), ("t", 1, "crawling"), ("u", 0, "created"), ("u", 1, "cancelled"), ("u", 2, "probing")]
    e = spark.createDataFrame(rows, "task_id string, task_version long, to_status string").withColumn("from_status", F.lit(None).cast("string"))
    assert sorted((r["task_id"], r["code"]) for r in events.audit_transitions(e).collect()) == [("t", "illegal_transition"), ("u", "terminal_exit")]


def test_identities_and_gaps(spark):
    c = spark.createDataFrame([(1, 1, 1, "pending"), (2, 1, 1, "done"), (3, 1, 4, "done")], "id long, book_id long, chapter_index int, status string")
    assert sorted((r["id"], r["winner"]) for r in books.merge_identities(c, "chapter_index").collect()) == [(1, False), (2, True), (3, True)]
    assert [r["chapter_index"] for r in books.missing_indexes(c).orderBy("chapter_index").collect()] == [2, 3]


def test_malformed_markup(spark):
    html = "<ul><li><a href='/1'>第1章 A</a><li><a href='/2'>第2章</a><li><a href=/3>chapter 3</a></ul><p>x<p>y"
    p = spark.createDataFrame([(1, "http://h/i", html), (2, "http://h/j", None)], "page_id long, url string, html string")
    nodes = pages.flatten(p)
    assert nodes.filter("tag = 'li'").count() == 3 and nodes.filter("tag = 'p'").count() == 2
    assert sorted(r["url"] for r in pages.links(p, nodes).collect()) == ["http://h/1", "http://h/2", "http://h/3"]
    assert {r["page_id"]: r["kind"] for r in pages.classify(p, nodes).collect()} == {1: "book_index", 2: "unknown"}


class Pieces(HTMLParser):
    """What stands between tags and comments, and which elements are open there."""

    def __init__(self, html):
        super().__init__()
        self.open, self.said, self.begun, self.fresh = [], [], 0, True
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag != "br":
            self.open.append(self.begun)
        self.begun, self.fresh = self.begun + 1, True

    def handle_endtag(self, tag):
        self.open.pop()
        self.fresh = True

    def handle_comment(self, data):
        self.fresh = True

    def handle_data(self, data):
        if self.fresh:
            self.said.append((tuple(self.open), ""))
        self.said[-1], self.fresh = (self.said[-1][0], self.said[-1][1] + data), False


def test_texts_follow_the_page(spark):
    """Mixed content against a walk through the markup, for every node."""
    rng = random.Random(3)

    def made(depth):
        tags = [rng.choice(["div", "b", "span", "br", "!", "text", "text"]) for _ in range(rng.randint(0, 5))]
        return "".join(f" w{rng.randrange(99)} < {rng.randrange(9)} &amp; " if t == "text" else "<br>" if t == "br" else "<!-- c -->" if t == "!" else f"<{t}>{made(depth + 1) if depth < 4 else ''}</{t}>" for t in tags)

    htmls = [f"<div>{made(0)}</div>" for _ in range(120)]
    p = spark.createDataFrame([(k, f"http://h/{k}", html) for k, html in enumerate(htmls)], "page_id long, url string, html string")
    nodes = pages.flatten(p)
    got = {(r["page_id"], r["node_id"]): r["text"] for r in pages.node_text(nodes, nodes, "|").collect()}
    want = {}
    for k, html in enumerate(htmls):
        for inside, said in Pieces(html).said:
            for node in inside if said.strip() else ():
                want.setdefault((k, node), []).append(said.strip())
    assert got == {k: "|".join(v) for k, v in want.items()} and len(got) > 300
    cut = dom.without(nodes, nodes.filter("tag = 'b'"))
    left = {(r["page_id"], r["node_id"]): r["text"] for r in pages.node_text(cut, cut, "|").collect()}
    bold = {(r["page_id"], r["node_id"]) for r in nodes.filter("tag = 'b'").collect()}
    kept = {}
    for k, html in enumerate(htmls):
        for inside, said in Pieces(html).said:
            if said.strip() and not any((k, node) in bold for node in inside):
                for node in inside:
                    kept.setdefault((k, node), []).append(said.strip())
    assert left == {k: "|".join(v) for k, v in kept.items()}


def test_mixed_texts_of_pages(spark):
    rows = [(1, "https://twbook.cc/1/1.html", "<h1>T</h1><article><p>one<br>two <i>three</i> four</p></article>"), (2, "https://shuyous.com/book/1-1.html", "<h1>T</h1><div id=content><p>one<br>two</p></div>"), (3, "https://else.test/1", "<h1>Chap<b>ter</b> 1</h1><article><p>one<br>two</p></article>")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    nodes = pages.flatten(p)
    assert {r["page_id"]: r["body"] for r in extract.site_chapters(p, nodes).collect()} == {1: "onetwothreefour", 2: "one two", 3: "onetwo"}
    rule = extract.configured_rule("x", {"title": "h1", "content": "article"})
    q = p.withColumn("url", F.lit("https://a.x.test/"))
    assert extract.site_chapters(q, nodes, (rule,), {"x.test": "x"}).filter("page_id = 1").first()["body"] == "one\ntwo\nthree\nfour"
    human = spark.createDataFrame([(1, "http://h/", "<title>A</title><p>verify <b>you are</b> human</p><input name=captcha>")], "page_id long, url string, html string")
    assert pages.classify(human, pages.flatten(human)).first()["evidence"] == ["auth.challenge_signals"]


CHALLENGE = "<title>Just a moment...</title><form action='/captcha'><input name='captcha'></form><p>Verify you are human</p>"
LOGIN = "<title>Login</title><form{}><input type='password'></form>"
CLASSES = [
    (200, "<title>星海纪元 - 章节目录</title><h1>星海纪元</h1><div id='list'><a href='/1'>第一章 启程</a><a href='/2.html'>第二章 风暴</a><a href='/read?cid=3'>第三章 星门</a><a href='/?chapter_id=4'>第四章 归途</a></div><form class='login-widget'><input type='password'></form>", "book_index", 0.93),
    (200, "<title>第一章 启程</title><h1>第一章 启程</h1><article id='content'><p>夜色落在港口</p></article>", "chapter", 0.95),
    (200, "<title>第二章 风暴</title><h1>第二章 风暴</h1><div class='chapter-content'>风暴席卷甲板</div>", "chapter", 0.95),
    (200, LOGIN.format(""), "auth_or_challenge", 0.98),
    (200, CHALLENGE, "auth_or_challenge", 0.96),
    (200, "<title>搜索结果</title><form role='search'></form><a href='/book'>星海纪元</a>", "search_or_list", 0.88),
    (200, "<title>社区动态</title><section class='comments'><a href='/1'>第一章</a><a href='/2'>第二章</a><a href='/3'>第三章</a></section><aside class='recommendations'><a href='/a'>推荐</a></aside>", "unknown", 0.0),
    (500, "<title>Novel chapter 1</title><article>content</article>", "error", 1.0),
    (200, "<title>第三章 归来</title><h1>第三章 归来</h1><div id='content'>主人公终于回到故乡。</div>", "chapter", 0.95),
    *[(status, CHALLENGE, "auth_or_challenge", 0.96) for status in (401, 403, 429, 503)],
    (500, CHALLENGE, "error", 1.0),
    (403, "<title>Access Denied</title>", "auth_or_challenge", 0.99),
    (200, "<title>Access Denied</title>", "unknown", 0.0),
    (200, LOGIN.format(" hidden"), "unknown", 0.0),
    (200, LOGIN.format(" style='display: none'"), "unknown", 0.0),
    (200, "<title>A</title><script>captcha</script><input name='captcha'>", "unknown", 0.0),
    (200, "<title>A</title><a href='/1'><span>Chapter 1</span></a><a href='/2'><span>Chapter 2</span></a><a href='/3'><b>Chapter 3</b></a>", "book_index", 0.93),
    (200, "<title>Page not found</title>", "error", 0.9),
    (200, "<title>A</title><input type='Search'>", "search_or_list", 0.88),
    (None, None, "unknown", 0.0),
    (404, None, "error", 1.0),
]


def test_page_classes(spark):
    rows = [(k, f"http://h/{k}", status, html) for k, (status, html, _, _) in enumerate(CLASSES)]
    p = spark.createDataFrame(rows, "page_id long, url string, status_code int, html string")
    got = {r["page_id"]: r for r in pages.classify(p, pages.flatten(p)).collect()}
    assert [(got[k]["kind"], got[k]["confidence"]) for k in range(len(CLASSES))] == [c[2:] for c in CLASSES]
    assert got[3]["evidence"] == ["auth.password_input"] and got[6]["evidence"] == []

"""Site reports, book facts, numbered catalogs and host names on small pages."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chapterlake.functions import urls
from chapterlake.operators import dom, explore, extract, pages
from chapterlake.streaming import tasks

LONG = "".join(f"<p>{'word ' * 20}</p>" for _ in range(3))
CATALOG = "<html><head><title>Tale_x</title><meta property='og:title' content='Tale'></head><body><span class='bookauthor'>A</span><div id='all'><a href='/'>home</a><ul id='list'><li><a href='/book/7-2.html'>Chapter 2</a></li><li><a href='/book/7-1.html'>Chapter 1</a></li><li><a href='/book/7-1-2.html'>Chapter 1</a></li></ul></div></body></html>"
FIRST = f"<html><body><h1 class='title'>Chapter 1</h1><div class='readbox'>{LONG}<script>x</script></div><a href='/book/7.html'>目录</a><a href='/book/7-1-2.html'>下一页</a></body></html>"
SECOND = "<html><body><h1>Chapter 2</h1><div class='readbox'><p>short</p></div><a href='/book/7.html'>目录</a></body></html>"
H = "https://h.test"


@pytest.fixture(scope="module")
def captured(spark):
    rows = [(1, f"{H}/book/7.html", CATALOG), (2, f"{H}/book/7-1.html", FIRST), (3, f"{H}/book/7-2.html", SECOND), (4, f"{H}/lost", "<a href='/gone'>目录</a>"), (5, f"{H}/bare", "<p>x</p>"), (6, f"{H}/null", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").cache()


def test_reports(spark, captured, tmp_path):
    nodes = pages.flatten(captured).cache()
    starts = captured.select("page_id").filter("page_id in (2, 4, 5, 6)")
    found = explore.explore(captured, nodes, starts)
    got = {r["page_id"]: r for r in found.collect()}
    assert set(got) == {2, 5, 6}  # the catalog of 4 is not captured
    r = got[2]
    assert r["catalog_url"] == f"{H}/book/7.html" and r["title_selector"] == "meta[property='og:title']" and r["author_selector"] == "[class*=author i]"
    assert r["chapter_list_selector"] == "#all a" and r["chapter_link_count"] == 2 and [x["title"] for x in r["chapter_links"]] == ["Chapter 1", "Chapter 2"]
    assert r["chapter_title_selector"] == "h1.title" and r["content_selector"] == "div.readbox" and r["sample_count"] == 2
    one, two = r["samples"]
    assert (one["content_chars"], one["paragraphs"], one["has_next_page"]) == (3 * 99 + 2, 3, True)
    assert (two["content_selector"], two["content_chars"], two["paragraphs"]) == ("body", len("Chapter 2 short 目录"), 1)
    assert [w["code"] for w in r["warnings"]] == ["content_short", "chapter_has_pagination"] and r["requires_dedicated_adapter"]
    bare = got[5]
    assert bare["chapter_link_count"] == 0 and bare["samples"] == [] and [w["code"] for w in bare["warnings"]] == ["catalog_links_low", "content_short"]
    assert bare["proposed_config"]["book"].asDict() == {"title_selector": "h1", "author_selector": ".author", "chapter_list_selector": "a"}
    explore.write_proposed_configs(found.filter("page_id = 2"), str(tmp_path / "c"))
    (line,) = [x for f in (tmp_path / "c").glob("part-*") for x in f.read_text().splitlines()]
    assert json.loads(line)["chapter"] == {"title_selector": "h1.title", "content_selector": "div.readbox", "paragraph_selector": "p"}
    with pytest.raises(ValueError):
        explore.explore(captured, nodes, starts, sample=6)


def test_book_info(spark):
    crumb = "<div class='position'><a href='/book/7.html'> The  Tale </a></div><h1>x</h1>"
    rows = [(1, "https://www.shuyous.com/book/7-1.html", crumb), (2, "https://www.shuyous.com/book/8.html", "<meta property='og:novel:book_name' content='M'><meta property='og:novel:author' content=' Au '>"), (3, "https://www.shuyous.com/book/9.html", "<p>x</p>"), (4, "https://twbook.cc/5", "<h2>T</h2><p>作者 / Someone</p>"), (5, "https://a.test/x", "<title>Book_site-y</title>"), (6, "https://a.test/y", None)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    nodes = pages.flatten(p).cache()
    got = {r["page_id"]: (r["title"], r["author"]) for r in extract.book_info(p, nodes).collect()}
    assert got == {1: ("The  Tale", None), 2: ("M", "Au"), 3: ("书友社小说", None), 4: ("T", "Someone"), 5: ("Book", None), 6: ("a.test", None)}
    assert {r["page_id"]: r["identity"] for r in extract.book_identity(p, nodes).collect()} == {1: "the tale", 2: "m", 3: None, 4: None, 5: None, 6: None}


def test_numbered_and_listed_catalogs(spark):
    html = "<a href='/book/7-3.html'>c</a><a href='/book/7-1.html'></a><a href='/book/7-3-2.html'>again</a><a href='/book/8-2.html'>other</a><a href='/book/7-9.html'>i</a>"
    p = spark.createDataFrame([(1, "https://www.shuyous.com/book/7.html", html)], "page_id long, url string, html string")
    links = pages.links(p, pages.flatten(p))
    rows = lambda **k: [(r["chapter_index"], r["title"]) for r in extract.numbered_catalog(p, links, **k).orderBy("chapter_index").collect()]
    assert rows() == [(1, "第1章"), (3, "c"), (9, "i")] and rows(start=2, count=1) == [(3, "c")]
    payloads = spark.createDataFrame([(1, "h.test", '{"list": ["a", null, " b "]}'), (2, "h.test", "{bad"), (3, "h.test", None), (4, "h.test", '{"list": []}')], "book_id long, host string, payload string")
    got = [(r["book_id"], r["chapter_index"], r["title"], r["url"]) for r in extract.listed_catalog(payloads, start=2).orderBy("chapter_index").collect()]
    assert got == [(1, 2, "", "https://h.test/#/book/1/2.html"), (1, 3, "b", "https://h.test/#/book/1/3.html")]


def test_domains(spark):
    pytest.importorskip("idna")
    hosts = {"A.Example.": "a.example", "bücher.de": "xn--bcher-kva.de", "BÜCHER.de..": "xn--bcher-kva.de", "faß.de": "xn--fa-hia.de", "a b.de": None, "x/y": None, "": None, "...": None, None: None, "a_b.de": None, "-a.de": None, "xn--bcher-kva.de": "xn--bcher-kva.de", "xn--ü.de": None, "例子.测试": "xn--fsqu00a.xn--0zwm56d", "a" * 64 + ".de": None}
    rows = spark.createDataFrame([(h,) for h in hosts] * 2, "host string")
    got = [(r["host"], r["domain"]) for r in urls.canonical_domains(rows).collect()]
    assert len(got) == 2 * len(hosts) and dict(got) == hosts


def test_covered_and_text_against_brute_force(spark):
    html = "<div class='a'>x<div>y<p>1</p></div><div class='a'>z<p>2<b>3</b></p></div>w</div><p>4</p>"
    p = spark.createDataFrame([(1, "u", html), (2, "u", html + "<div class='a'></div>")], "page_id long, url string, html string")
    rows = pages.flatten(p).collect()
    nodes = spark.createDataFrame(rows, pages.NODES)
    inside = lambda r, t: r["page_id"] == t["page_id"] and t["node_id"] < r["node_id"] <= t["end_id"]
    tops = [r for r in rows if (r["attrs"] or {}).get("class") == "a"]
    want = {(r["page_id"], r["node_id"]) for r in rows if r["tag"] == "p" and any(inside(r, t) for t in tops)}
    assert {(r["page_id"], r["node_id"]) for r in dom.select(nodes, ".a p").collect()} == want
    gone = {(r["page_id"], r["node_id"]) for r in rows if any(inside(r, t) or r == t for t in tops)}
    assert {(r["page_id"], r["node_id"]) for r in dom.without(nodes, dom.select(nodes, ".a")).collect()} == {(r["page_id"], r["node_id"]) for r in rows} - gone
    said = {(r["page_id"], r["node_id"]): r["text"] for r in pages.node_text(nodes, nodes, "|").collect()}
    for t in rows:
        own = lambda r: r["own_pieces"] or [(r["node_id"], r["own_text"])] * bool(r["own_text"])
        pieces = [said for *_, said in sorted((at, -r["node_id"], k, said) for r in rows if inside(r, t) or r == t for k, (at, said) in enumerate(own(r)))]
        assert said.get((t["page_id"], t["node_id"])) == ("|".join(pieces) if pieces else None)


def test_wait_expires_by_event_time(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    path = ["created", "probing", "waiting_for_user"]
    shape = "task_id string, task_version long, to_status string, created_at timestamp"
    first = [("a", k, s, t0 + timedelta(minutes=k)) for k, s in enumerate(path)]
    late = [("b", 0, "created", t0 + timedelta(hours=3))]
    for k, rows in enumerate([first, late, [("c", 0, "created", t0 + timedelta(hours=4))]]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        q = tasks.start(spark, tasks.task_states(stream, "30 minutes", "10 minutes").writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True))
        q.awaitTermination()
    got = [(r["version"], r["status"], r["resume_status"], r["code"]) for r in spark.read.parquet(str(tmp_path / "out")).filter(F.col("task_id") == "a").orderBy("version").collect()]
    assert got[0][:2] == (2, "waiting_for_user") and got[-1] == (3, "recoverable_failed", "waiting_for_user", "wait_expired") and len(got) == 2

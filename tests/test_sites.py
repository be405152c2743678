"""Selectors, extraction, candidates, configs and streams on small pages."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chapterlake.functions import urls
from chapterlake.operators import adapt, books, configs, dedup, dom, extract, pages, tts
from chapterlake.plans import site_queries
from chapterlake.sources import exports, readers
from chapterlake.streaming import tasks

LINES = "".join(f"<p>{'word ' * 12}{k}</p>" for k in range(3))
CATALOG = "<html><head><title>A Tale</title></head><body><h1>A Tale</h1><div id='list'><ul>" + "".join(f"<li><a href='/b/{k}.html'>Chapter {k}</a></li>" for k in (1, 2, 3)) + "</ul></div><aside class='recommend'><a href='/z/9.html'>Chapter 9</a></aside></body></html>"
CHAPTER = f"<html><body><h1>Chapter 1</h1><article id='content'>{LINES}<div class='comment-box'><p>noise words</p></div></article><a rel='next' href='/b/2.html'>go</a><a href='/b/'>目录</a></body></html>"


@pytest.fixture(scope="module")
def captured(spark):
    rows = [(1, "http://h.test/b/", CATALOG), (2, "http://h.test/b/1.html", CHAPTER), (3, "http://h.test/e", ""), (4, "http://h.test/n", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").cache()


@pytest.fixture(scope="module")
def nodes(captured):
    return pages.flatten(captured).cache()


@pytest.mark.parametrize(
    "selector, count",
    [("a", 6), ("ul > li", 3), ("body a", 6), ("div a", 3), ("#list li a", 3), (".recommend > a", 1), ("[rel]", 1), ("a[href^='/b/']", 5), ("a[href*='HTML' i]", 5), ("li:nth-of-type(2) a", 1), ("h1, title", 3), ("nav", 0), ("body > a", 2)],
)
def test_selectors(nodes, selector, count):
    assert dom.select(nodes, selector).count() == count


def test_unsupported_selectors(nodes):
    for bad in ("", "a:has(b)", "a + b", "a b c d e f", "x" * 600):
        assert dom.parse(bad) is None
    got = dom.select_all(nodes, {"good": "h1", "bad": "a:has(b)"}).collect()
    assert {(r["name"], r["error_code"]) for r in got} == {("good", None), ("bad", "selector_invalid")}


def test_noise_and_totals(nodes):
    kept = dom.denoised(nodes)
    assert kept.filter("own_text = 'noise words'").count() == 0 and kept.filter("tag = 'aside'").count() == 0
    gone = dom.blanked(nodes, dom.select(nodes, ".comment-box"))
    assert gone.count() == nodes.count() and gone.filter("own_text = 'noise words'").count() == 0
    total = {r["tag"]: r["n"] for r in dom.subtree_totals(nodes.filter("page_id = 1"), n=F.col("tag") == "a").collect()}
    assert total["html"] == 4 and total["ul"] == 3 and total["aside"] == 1


def matches(rows, selector):
    """Nodes that a path, an id or a class set selects, by going through all."""
    by_id = {r["node_id"]: r for r in rows}

    def fits(r, step):
        tag, _, place = step.partition(":nth-of-type(")
        return r["tag"] == tag and (not place or r["sibling_pos"] == int(place[:-1]))

    if selector[0] == "#":
        return [r["node_id"] for r in rows if dict(r["attrs"]).get("id") == selector[1:]]
    if selector[0] == ".":
        return [r["node_id"] for r in rows if set(selector[1:].split(".")) <= set(dict(r["attrs"]).get("class", "").split())]
    out = []
    for r in rows:
        at, steps = r, selector.split(" > ")
        while steps and at is not None and fits(at, steps[-1]):
            steps, at = steps[:-1], by_id.get(at["parent_id"])
        if not steps:
            out.append(r["node_id"])
    return out


def test_paths_are_unique_and_shortest(spark, nodes):
    rng = random.Random(4)
    tags = ["div", "p", "ul", "li", "span", "a"]

    def tree(depth):
        attrs = rng.choice(["", "", " class='chapter body'", " class=body", " id=content", " id='x1'", " class='token-list'"])
        tag = rng.choice(tags)
        return f"<{tag}{attrs}>{''.join(tree(depth - 1) for _ in range(rng.randint(0, 3))) if depth else 't'}</{tag}>"

    made = spark.createDataFrame([(100 + k, f"<html><body>{tree(4)}{tree(3)}</body></html>") for k in range(30)], "page_id long, html string")
    every = nodes.unionByName(pages.flatten(made))
    found = dom.paths(every).collect()
    assert len(found) == every.count()
    by_page = {}
    for r in every.orderBy("page_id", "node_id").collect():
        by_page.setdefault(r["page_id"], []).append(r)
    for r in found:
        rows = by_page[r["page_id"]]
        assert matches(rows, r["selector"]) == [r["node_id"]], r["selector"]
        if " > " in r["selector"]:
            assert len(matches(rows, r["selector"].split(" > ", 1)[1])) > 1
    some = every.filter("tag = 'a'").select("page_id", "node_id")
    assert {(r["page_id"], r["node_id"], r["selector"]) for r in dom.paths(every, some).collect()} == {(r["page_id"], r["node_id"], r["selector"]) for r in found if r["tag"] == "a"}


@pytest.mark.parametrize(
    "attrs, selector",
    [("id=content", "#content"), ("id=body:main class='reader body'", ".reader.body"), ("id=a1b2c3d4e5-list", "i"), ("id=session-list", "i"), ("class='book said'", ".book"), ("id='user@book'", "i"), ("class='title-words'", "i"), ("id=" + "list-" * 10, "i"), ("id=zebra", "i")],
)
def test_names_in_paths(spark, attrs, selector):
    page = spark.createDataFrame([(1, f"<body><i {attrs}>title <u>words</u></i></body>")], "page_id long, html string")
    assert dom.paths(pages.flatten(page)).filter("tag = 'i'").first()["selector"] == selector


def test_names_are_held_against_texts_in_page_order(spark):
    rows = ["chapter <u>ti</u>tle", "chapter<br> tit<u>l</u>e", "<u>chap</u>ter title", "title <u>chapter</u>", "chapter <u>title</u> x", "chapter <u>title</u></i> x<i>"]
    page = spark.createDataFrame([(k, f'<body><i class="chapter-title">{r}</i></body>') for k, r in enumerate(rows)], "page_id long, html string")
    found = dom.paths(pages.flatten(page)).filter("attrs['class'] is not null").collect()
    named = {r["page_id"] for r in found if r["selector"] == ".chapter-title"}
    assert named == {3, 4}  # what the others say is their name


@pytest.mark.parametrize(
    "html, tree",
    [
        ("<p>one<div>two</div>", "p div"), ("<p>a<span>b<ul><li>c</ul>", "p(span) ul(li)"), ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt dd dt)"), ("<table><td>a<th>b<tr><td>c</table>", "table(td th tr(td))"),
        ("<ul><li><b>x<li><b>y</ul>", "ul(li(b) li(b))"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "ul(li(ul(li)) li)"), ("<select><option>a<option>b<optgroup><option>c<optgroup></select>", "select(option option optgroup(option) optgroup)"),
        ("<head><title>t</title><body><p>x", "head(title) body(p)"), ("<head><title>t</title><h1>x</h1>", "head(title) h1"), ("<a>x<a>y</a>", "a a"), ("<h1>x<h2>y</h2>", "h1 h2"), ("<table><tr><td><p>a<td>b<tbody><tr><td>c</table><p>d", "table(tr(td(p) td) tbody(tr(td))) p"),
        ("<table><tr><td><ul><li>a</table></ul>", "table(tr(td(ul(li))))"), ("<div><b>x</div>y</b>z", "div(b)"), ("<b><div>x</b>y</div>", "b(div)"), ("<td><div></td>x", "td(div)"), ("<p>a<p>b</p></p>c", "p p"), ("<li><p>x<li>y", "li(p) li"), ("<ruby>a<rt>b<rp>c</ruby>", "ruby(rt rp)"), ("<div><p>x<table><tr><td><p>y</td></tr></table>z</div>", "div(p table(tr(td(p))))"),
    ],
)
def test_implied_ends(spark, html, tree):
    rows = pages.flatten(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("node_id").collect()
    below = {}
    for r in rows:
        below.setdefault(r["parent_id"], []).append(r)
    shown = lambda r: r["tag"] + (f"({' '.join(map(shown, below[r['node_id']]))})" if r["node_id"] in below else "")
    assert " ".join(map(shown, below[None])) == tree
    ends = {r["node_id"]: r["end_id"] for r in rows}
    assert all(r["parent_id"] is None or r["end_id"] <= ends[r["parent_id"]] for r in rows) and [r["node_id"] for r in rows] == list(range(len(rows)))


def test_fingerprints(spark):
    htmls = ["<body><p>one</p></body>", "<body><p>other words</p></body>", "<body><p>a</p><p>b</p></body>", "<body><p>one</p><div class='ad-top'><a>x</a></div></body>"]
    n = pages.flatten(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string"))
    a, b, c, d = (r["digest"] for r in dom.fingerprints(n, "s").orderBy("page_id").collect())
    assert a == b == d != c and dom.fingerprints(n, "t").orderBy("page_id").first()["digest"] != a


def test_navigation_and_catalog(captured, nodes):
    links = extract.anchors(captured, nodes)
    got = {(r["page_id"], r["field"]): (r["url"], r["score"]) for r in extract.navigation(links).collect()}
    assert got == {(2, "next_link"): ("http://h.test/b/2.html", 0.9), (2, "index_link"): ("http://h.test/b/", 0.7)}
    listed = extract.catalog(links.filter("page_id = 1"), start=2, count=2).orderBy("chapter_index").collect()
    assert [(r["chapter_index"], r["title"]) for r in listed] == [(2, "Chapter 2"), (3, "Chapter 3")]
    assert {r["page_id"]: r["catalog_url"] for r in extract.catalog_links(links).collect()}[2] == "http://h.test/b/"


def test_inspection_and_bodies(captured, nodes):
    got = {r["page_id"]: r for r in extract.inspect(captured, nodes).collect()}
    assert len(got) == 4 and got[1]["list_selector"] == "#list a" or got[1]["list_selector"] == "a"
    assert got[2]["content_selector"] == "#content" and got[2]["title_selector"] == "h1" and got[4]["title_selector"] is None
    body = {r["page_id"]: (r["title"], r["body"]) for r in extract.chapters(nodes).collect()}[2]
    assert body[0] == "Chapter 1" and body[1].split("\n")[0].endswith("word 0") and len(body[1].split("\n")) == 4


def test_chains(spark):
    pairs = [(str(k), str(k + 1)) for k in range(1, 9)] + [("x", "y"), ("y", "x"), ("z", None)]
    following = spark.createDataFrame(pairs, "url string, next_url string")
    starts = spark.createDataFrame([("1",), ("x",), ("z",)], "url string")
    got = {}
    for r in extract.next_chains(starts, following).collect():
        got.setdefault(r["start_url"], []).append((r["position"], r["url"]))
    assert sorted(got["1"]) == [(k, str(k + 1)) for k in range(9)] and sorted(got["x"]) == [(0, "x"), (1, "y")] and got["z"] == [(0, "z")]
    assert extract.next_chains(starts, following, limit=3).filter("start_url = '1'").count() == 3


def test_candidates_scores_decisions(captured, nodes):
    kinds = captured.filter("page_id < 3").select("page_id", F.when(F.col("page_id") == 1, "book_index").otherwise("chapter").alias("kind"))
    c = adapt.context(captured, nodes, kinds)
    found = adapt.candidates(c)
    fields = {(r["page_id"], r["field"]) for r in found.collect()}
    assert fields >= {(1, "title"), (1, "chapter_list"), (1, "clean_selector"), (2, "chapter_title"), (2, "content"), (2, "next_link"), (2, "index_link")}
    scored = adapt.score(c, found)
    best = {(r["page_id"], r["field"]): r["score"] for r in scored.filter("rank = 1").collect()}
    # three links in a row: (2 * 3/20 + 3 * 1 + 1 + 4) / 10
    assert abs(best[1, "chapter_list"] - 0.83) < 1e-9 and best[2, "chapter_title"] > 0.9 and 0 < best[2, "content"] < 1
    decided = adapt.decide(kinds, adapt.decide_fields(kinds, scored)).collect()
    assert {r["page_id"]: r["decision"] for r in decided}[1] == "require_confirmation"


@pytest.mark.parametrize("scores, status", [([0.5999], "reject"), ([0.60], "require_confirmation"), ([0.8499], "require_confirmation"), ([0.85], "auto_accept"), ([0.9, 0.870001], "require_confirmation"), ([0.9, 0.87], "auto_accept"), ([], "reject")])
def test_decision_limits(spark, scores, status):
    kinds = spark.createDataFrame([(1, "chapter")], "page_id long, kind string")
    rows = [(1, f, f"s{k}", s, k + 1) for f in ("chapter_title", "content") for k, s in enumerate(scores)]
    scored = spark.createDataFrame(rows, "page_id long, field string, selector string, score double, rank int")
    assert {r["status"] for r in adapt.decide_fields(kinds, scored).collect()} == {status}


def test_refused_kinds(spark):
    kinds = spark.createDataFrame([(1, "error"), (2, "unknown")], "page_id long, kind string")
    scored = spark.createDataFrame([], "page_id long, field string, selector string, score double, rank int")
    got = adapt.decide(kinds, adapt.decide_fields(kinds, scored)).orderBy("page_id").collect()
    assert [(r["decision"], r["code"]) for r in got] == [("reject", "error_page"), ("reject", "unsupported_page")]


def test_three_pages(spark):
    page = "page_id: long, next_ok: boolean, auth_or_error: boolean, fingerprint: string, identity_ok: boolean, chars: long, paragraphs: long, decision: string"
    good = (1, True, False, "f", True, 100, 2, "auto_accept")
    other = (2, True, False, "f", True, 900, 2, "require_confirmation")
    rows = [("a", True, "auto_accept", {"t": 0.9}, good, other[:5] + (500,) + other[6:]), ("b", False, "auto_accept", {"t": 0.9}, good, other)]
    got = adapt.validate_three(spark.createDataFrame(rows, f"site string, catalog_order_ok boolean, index_decision string, scores map<string,double>, first struct<{page}>, second struct<{page}>")).orderBy("site").collect()
    assert (got[0]["ok"], got[0]["confidence"]) == (True, 0.84)
    assert got[1]["reasons"] == ["catalog_order_invalid", "content_shape_invalid"] and got[1]["confidence"] == 0


def test_drift(spark):
    stored = spark.createDataFrame([("a", "active", {"t": 0.9}, "f"), ("b", "revoked", {}, "f"), ("c", "active", {"t": 0.9}, "f"), ("d", "active", {"t": 0.9}, "f"), ("e", "active", {"t": 0.9}, None)], "config_id string, status string, fields map<string,double>, fingerprint string")
    seen = spark.createDataFrame([("a", False, False, False, {"t": 0.95}, "f"), ("c", False, False, False, {"t": 0.86}, "f"), ("d", False, False, False, {"t": 0.9}, "g")], "config_id string, transient boolean, hard_error boolean, auth boolean, scores map<string,double>, fingerprint string")
    got = {r["config_id"]: (r["status"], r["reason"]) for r in adapt.drift(stored, seen).collect()}
    assert got == {"a": ("valid", None), "b": ("invalid", "config_revoked"), "c": ("stale", "score_below_threshold"), "d": ("stale", "fingerprint_mismatch"), "e": ("stale", "fingerprint_baseline_missing")}


def _config(**changed):
    row = dict(config_id="cfg_" + "a" * 16, site="s", domain="h.com", version=1, status="active", validated="2024", url_patterns=["/b/{int}"], selectors=(["script"], {"title": "h1", "chapter_list": "li a"}, {"content": "#c", "paragraph": "p"}), request_policy=(10.0, 3, 1.0), field_scores={"title": 0.9})
    return tuple((row | changed).values())


def test_configs(spark):
    rows = [_config(), _config(domain="bad"), _config(url_patterns=["/**/x"]), _config(request_policy=(0.0, 11, 1.0)), _config(field_scores={"Title": 2.0}), _config(selectors=(["a:has(b)"], {}, {}))]
    df = spark.createDataFrame(rows, readers.CONFIG)
    got = [set(r["errors"]) for r in configs.strict_errors(df.coalesce(1)).collect()]
    assert got == [set(), {"domain"}, {"url_patterns"}, {"timeout_seconds", "max_retries"}, {"field_scores"}, {"selectors"}]
    checked = configs.check(spark.createDataFrame([_config(), _config(site=None, selectors=([], {}, {}))], readers.CONFIG).coalesce(1)).collect()
    assert checked[0]["valid"] and checked[1]["errors"] == ["site", "chapter.content"] and len(checked[1]["warnings"]) == 3
    two = spark.createDataFrame([_config(), _config(version=2, status="revoked")], readers.CONFIG)
    assert [r["version"] for r in configs.latest(two).collect()] == [2] and configs.status_history(two).count() == 2
    asked = spark.createDataFrame([(1, "https://h.com/b/7"), (2, "https://h.com/c"), (3, None)], "page_id long, url string")
    assert [r["page_id"] for r in configs.active_for(asked, df.limit(1)).collect()] == [1] and configs.active_for(asked, two).count() == 0


def test_decoding(spark):
    rows = [(1, "中文".encode("gb18030"), "text/html; charset=gbk"), (2, "中文".encode(), None), (3, "正文内容".encode("gb18030"), ""), (4, None, None), (5, b"ok", "text/html; charset=nonsense")]
    got = {r["page_id"]: (r["encoding"], r["html"]) for r in readers.decode_pages(spark.createDataFrame(rows, "page_id long, body binary, content_type string")).collect()}
    assert got == {1: ("gbk", "中文"), 2: ("utf-8", "中文"), 3: ("gb18030", "正文内容"), 4: ("utf-8", None), 5: ("utf-8", "ok")}


def test_exchange_and_manifest(spark):
    shelf = spark.createDataFrame([(1, "T"), (2, "U")], "book_id long, title string")
    rows = spark.createDataFrame([(1, 2, "b", "done", "b\ntext"), (1, 1, "a", "done", "x"), (1, 3, "c", "failed", "y"), (2, 1, "a", "done", " ")], "book_id long, chapter_index int, title string, status string, body string")
    got = {r["book_id"]: r for r in exports.to_exchange(shelf, rows).collect()}
    assert '"number":1' in got[1]["document"] and '"content":"text"' in got[1]["document"] and got[2]["error_code"] == "no_completed_chapters"
    assert exports.markdown_head(shelf).orderBy("book_id").first()["head"].startswith("# T\n\n")
    assert tts.manifests(rows.select("book_id", F.col("chapter_index").alias("chapter_number"), F.lit("i").alias("chapter_id"), F.lit("t").alias("chapter_title"), F.lit("COMPLETED").alias("status"))).filter("status = 'COMPLETED'").count() == 2


def test_failures_and_deletion(spark):
    c = spark.createDataFrame([(1, 1, "pending", None, 0, None, "h"), (2, 1, "done", None, 0, None, "h"), (3, 2, "failed", "x", 1, "w", "h")], "id long, book_id long, status string, error string, attempt_count int, claim_owner string, content_hash string")
    f = spark.createDataFrame([(1, "odd"), (2, "odd"), (3, "parse_failed")], "id long, error string")
    got = {r["id"]: (r["status"], r["error"], r["attempt_count"]) for r in books.mark_failed(c, f).collect()}
    assert got == {1: ("failed", "chapter_download_failed", 1), 2: ("done", None, 0), 3: ("failed", "parse_failed", 1)}
    gone = c.select("book_id").filter("book_id = 1").distinct()
    assert books.deletable_content(c, gone).count() == 0 and books.delete_books({"c": c}, gone)["c"].count() == 1


def test_live_states(spark, tmp_path):
    moves = [("t", 0, "created"), ("t", 1, "probing"), ("t", 2, "paused"), ("u", 0, "created"), ("u", 1, "completed"), ("v", 0, "created"), ("v", 2, "probing")]
    at = datetime(2024, 1, 1)
    spark.createDataFrame([(*m, at) for m in moves], "task_id string, task_version long, to_status string, created_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("task_id string, task_version long, to_status string, created_at timestamp").parquet(str(tmp_path / "in"))
    q = tasks.start(spark, tasks.task_states(stream).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True))
    q.awaitTermination(15)  # timeouts by the clock keep the stream awake
    q.stop()
    got = {r["task_id"]: (r["status"], r["version"], r["resume_status"], r["code"]) for r in spark.table("live").collect()}
    assert got == {"t": ("paused", 2, "probing", None), "u": ("created", 0, None, "illegal_transition"), "v": ("created", 0, None, "version_conflict")}


def test_intake(spark, tmp_path):
    rows = [("http://h.test/a#x", datetime(2024, 1, 1)), ("http://h.test/a", datetime(2024, 1, 1)), ("bad", datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "url string, retrieved_at timestamp").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema("url string, retrieved_at timestamp").parquet(str(tmp_path / "in"))
        tasks.intake(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert [r["canonical_url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["http://h.test/a"]


def test_chapter_order(spark):
    rows = spark.createDataFrame([("http://h/b/10.html",), ("http://h/b/2.html",), ("http://h/x",)], "u string")
    assert [r["u"] for r in rows.orderBy(urls.chapter_order(F.col("u"))).collect()] == ["http://h/b/2.html", "http://h/b/10.html", "http://h/x"]


def test_long_chains_and_page_ids(spark, tmp_path):
    n = 10_050
    links = spark.range(n).selectExpr("cast(id as string) as url", "cast(id + 1 as string) as next_url")
    chain = extract.next_chains(spark.createDataFrame([("0",)], "url string"), links)
    assert chain.agg(F.max("position")).first()[0] == n and chain.count() == n + 1
    turns = [(1, 100_000, "user", "a"), (1, 99_999, "user", "b"), (2, 0, "user", "c")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    bodies = site_queries.chapter_bodies(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["title"], r["body"]) for r in bodies) == [(199_999, "第99999章", "b"), (200_000, "第0章", "c"), (200_000, "第100000章", "a")]
    chains = site_queries.next_chains(spark, str(tmp_path)).collect()
    assert sorted((r["position"], r["url"]) for r in chains) == [(0, "http://shelf.test/book/1/99999.html"), (0, "http://shelf.test/book/2/0.html"), (1, "http://shelf.test/book/1/100000.html")]


def test_patterns_are_met_by_keys(spark):
    patterns = ["/**", "/a/**", "/a/*", "/a/{int}", "/a/{slug}/x", "/{slug}/{int}.html", "https://h.test/a/**", "https://h.test:8/a/*", "/a", "/", "/a//b", "a", "/{int}-{int}", "/*/*/*", "/**/x", None, "/a/b-{int}.html"]
    rng = random.Random(2)
    made = ["/" + "/".join(rng.choice(["a", "1", "x", "b-2.html", "3.html", "", "**"]) for _ in range(rng.randint(0, 4))) for _ in range(60)]
    asked = [f"{h}{p}" for h in ("https://h.test", "http://h.test", "https://h.test:8", "https://other.test") for p in [*made, "", "/a/%62-1.html", "/a/../a/1", "/a?q=1"]]
    pages_ = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    rows = [(d, f"c{k}", 1, "active", f"{k:02d}", [p]) for d in ("h.test", "other.test") for k, p in enumerate(patterns)]
    stored = spark.createDataFrame([(d, c + d, *r) for d, c, *r in rows], "domain string, config_id string, version int, status string, validated string, url_patterns array<string>")
    every = pages_.withColumn("domain", urls.host(F.col("url"))).filter(urls.valid_url(F.col("url"))).join(stored.select("domain", "config_id", "validated", F.col("url_patterns")[0].alias("p")), "domain").filter(urls.pattern_matches(F.col("url"), F.col("p")))
    want = {r["page_id"]: r["c"] for r in every.groupBy("page_id").agg(F.max_by("config_id", "validated").alias("c")).collect()}
    assert {r["page_id"]: r["config_id"] for r in configs.active_for(pages_, stored).collect()} == want and len(want) > 50


def test_similar_pairs_of_hot_keys_and_by_minhash(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(6)]
    rows = []
    for k in range(120):
        body = list(base[k % 6])
        for _ in range(rng.randint(0, 3)):
            body[rng.randrange(60)] = rng.choice("abcdefghxyz")
        rows.append(("b" if k % 3 else "c", k, "".join(body)))
    rows += [("b", 500 + k, t) for k, t in enumerate([None, "", "x", "x", "same " * 5000, "same " * 5000 + "!"])]
    chapters = spark.createDataFrame(rows, "book_id string, chapter_index int, body string")
    grams = lambda t: {t[k : k + 2] for k in range(len(t) - 1)} or {t}
    least = {}
    for b, k, t in rows:
        if t:
            least.setdefault((b, t), k)
    items = sorted((b, k, grams(t)) for (b, t), k in least.items())
    want = {(b, i, j) for b, i, g in items for c, j, h in items if b == c and i < j and len(g & h) >= 0.85 * len(g | h) - 1e-12}
    hot, dedup.HOT = dedup.HOT, 10**6  # every key is hot
    try:
        assert {(r["book_id"], r["a"], r["b"]) for r in dedup.similar_pairs(chapters).collect()} == want and len(want) > 20
    finally:
        dedup.HOT = hot
    assert {(r["book_id"], r["a"], r["b"]) for r in dedup.similar_pairs(chapters).collect()} == want
    got = {(r["book_id"], r["a"], r["b"]) for r in dedup.approximate_pairs(chapters).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_chapters_by_site_rules(spark):
    rows = [
        (1, "https://www.bqg9.cc/book/1/1.html", "<div id=title>T</div><div class=content>上一章<div>one</div><div>two<script>x</script></div></div>"), (2, "https://www.bqg9.cc/book/1/2.html", "<h1>none</h1>"), (3, "https://shuyous.com/book/1-1.html", "<div class=readCon><h1>T</h1><div class=content>only <b>text</b></div></div>"),
        (4, "https://twbook.cc/1/1.html", "<h1>T</h1><article><p>a</p></article>"), (5, "https://else.test/1", "<h1>T</h1><article><p>a</p></article>"), (6, "https://twbook.cc/1/2.html", None),
    ]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["site"], r["title"], r["body"]) for r in extract.site_chapters(p, pages.flatten(p)).collect()}
    assert got == {1: ("bqg", "T", "one\ntwo"), 2: ("bqg", "", ""), 3: ("shuyous", "T", "only text"), 4: ("twbook", "T", "a"), 5: ("auto", "T", "a"), 6: ("twbook", "", "")}
    rule = extract.configured_rule("x", {"title": "h2", "content": ".c"}, (".no",))
    q = spark.createDataFrame([(1, "https://a.x.test/", "<h2>T</h2><div class=c><p>a</p><p class=no>b</p><object>o</object></div>")], "page_id long, url string, html string")
    assert extract.site_chapters(q, pages.flatten(q), (rule,), {"x.test": "x"}).first()["body"] == "a"


def test_pages_are_followed_once(spark):
    rows = [(1, 1, None, "u1", "u2", "a"), (1, 1, 2, "u2", "u3", ""), (1, 1, 3, "u3", "u1", "c"), (1, 2, None, "v1", "u1", "x"), (2, 1, None, "w1", "lost", "y")] + [(3, 1, k, f"p{k}", f"p{k + 1}", str(k)) for k in range(1, 31)]
    parts = spark.createDataFrame(rows, "book_id long, chapter_number long, page_number int, url string, next_url string, body string")
    got = {(r["book_id"], r["chapter_number"]): (r["body"], r["pages"]) for r in extract.merge_followed(parts).collect()}
    assert got == {(1, 1): ("a\nc", 3), (1, 2): ("x", 1), (2, 1): ("y", 1), (3, 1): ("\n".join(map(str, range(1, 21))), 20)}


@pytest.mark.parametrize("name", ["list_scores", "page_decisions"])
def test_tables_that_grow_with_the_pages_are_not_broadcast(spark, tmp_path, name):
    """Kept tables pack so well that they would go through the driver whole."""
    spark.range(400).select((F.col("id") % 100).alias("l_orderkey"), F.floor(F.col("id") / 100).cast("int").alias("l_linenumber")).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = getattr(site_queries, name)(spark, str(tmp_path))
    assert found.count() == 100
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()

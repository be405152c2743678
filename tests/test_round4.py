"""Pages of one structure, searched and laid out once; paths and links in the
pass that parses; parts of urls read once."""

import random

from pyspark.sql import functions as F

from chapterlake.operators import dom, extract, pages, routing

SCHEMA = "page_id long, url string, html string"


def made_pages(spark, n=300):
    rng = random.Random(7)
    parts = '<p> </p> <ul> <li> </ul> <div|class="entry|x"> </div> <b|id="item-main"> </b> <a|href="/1"> <a|href="?q"> </a> <a> entry itemmain t&amp; <br> <!--c--> <title> <h1|class="title">'.split()
    html = ["".join(rng.choice(parts).replace("|", " ") for _ in range(rng.randrange(1, 24))) for _ in range(n)]
    return spark.createDataFrame([(k, f"http://h.test/b/{k}", h) for k, h in enumerate([*html, *html[: n // 2], "", None])], SCHEMA)


def test_paths_in_the_pass_that_parses(spark):
    made = made_pages(spark)
    for plain in (False, True):
        want = {(r["page_id"], r["node_id"]): (r["tag"], r["selector"]) for r in dom.paths(pages.flatten(made), plain=plain).collect()}
        got = {(r["page_id"], r["node_id"]): (r["tag"], r["selector"]) for r in pages.located(made, plain=plain).collect()}
        assert got == want and len(got) > 1000
    items = spark.createDataFrame([(1, "<ul><li>a<li>b<p>c</ul>"), (2, "<p>d")], "page_id long, html string")
    found = pages.located(items, lambda tag, attrs: tag in ("li", "p")).collect()
    assert sorted((r["page_id"], r["tag"], r["nth"], r["selector"]) for r in found) == [(1, "li", 1, "li:nth-of-type(1)"), (1, "li", 2, "li:nth-of-type(2)"), (1, "p", 1, "p"), (2, "p", 1, "p")]


def test_links_in_the_pass_that_parses(spark):
    made = made_pages(spark)
    want = sorted(map(repr, pages.links(made, pages.flatten(made)).collect()))
    assert sorted(map(repr, pages.page_links(made).collect())) == want and len(want) > 100


def test_pages_of_one_structure_are_searched_and_laid_out_once(monkeypatch):
    searched, laid = [], []
    search, close = dom._Page.selectors, pages._Flat.handle_starttag
    monkeypatch.setattr(dom._Page, "selectors", lambda self, *a: searched.append(1) or search(self, *a))
    monkeypatch.setattr(pages._Flat, "handle_starttag", lambda self, *a: laid.append(1) or close(self, *a))
    pages._LAYOUTS.clear()
    found, find = [], dom.Search()
    for text in ["one", "two", "entry", "three"]:
        flat = pages._Flat()
        flat.page(1, f'<div class="entry"><p>{text}</p></div><p>x</p>')
        c = flat.columns
        classes = [dict(a).get("class") for a in c["attrs"]]
        found.append(find(c["node_id"], c["parent_id"], c["end_id"], c["tag"], c["sibling_pos"], [None] * 3, classes, lambda c=c: (c["own_text"], c["own_pieces"]), [0])[0])
    # a class that says what the node says does not name it: that page answers otherwise
    assert found == [".entry", ".entry", "div", ".entry"]
    assert len(laid) == 3 and len(searched) == 3


def test_a_url_is_parted_once(spark):
    urls = spark.createDataFrame([("https://www.twbook.cc/7/3.html",)], "url string")
    plan = routing.url_parts(urls)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^.*@") == 1
    assert routing.url_parts(urls).select("site", "book_id", "chapter_number").first() == ("twbook", "7", 3)


def test_catalogs_are_not_written_as_nodes(spark, tmp_path, monkeypatch):
    """Queries that read paths or links alone write no table of nodes."""
    from chapterlake.plans import site_queries

    spark.range(40).select((F.col("id") % 10).alias("l_orderkey"), (F.floor(F.col("id") / 10) + 1).cast("int").alias("l_linenumber")).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(site_queries, "_nodes", None)
    for name, rows in (("link_paths", 40), ("repeated_name_paths", 80), ("numbered_chapters", 40)):
        assert getattr(site_queries, name)(spark, str(tmp_path)).count() == rows


def test_selectors_of_two_steps_share_a_window(spark):
    nodes = pages.flatten(made_pages(spark))
    wanted = ["ul a", ".entry b", "div .x", "#item-main p", "li li", "div > b", "p"]
    found = dom.select_each(nodes, wanted)
    got = sorted((r["selector"], r["position"], r["page_id"], r["node_id"]) for r in found.collect())
    assert got == sorted((s, k, r["page_id"], r["node_id"]) for k, s in enumerate(wanted) for r in dom.select(nodes, s).collect()) and len(got) > 100
    assert dom.select_each(nodes, wanted[:5])._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_totals_of_asked_nodes(spark):
    nodes = pages.flatten(made_pages(spark)).cache()
    sums = {"chars": F.length("own_text"), "pieces": F.col("own_text") != "", "paragraphs": F.col("tag") == "p"}
    asked = nodes.filter("tag in ('div', 'a', 'p')")
    want = sorted(tuple(r) for r in dom.subtree_totals(nodes, **sums).filter("tag in ('div', 'a', 'p')").select("page_id", "node_id", *sums).collect())
    assert sorted(tuple(r) for r in dom.totals_of(nodes, asked, **sums).collect()) == want and len(want) > 100


def test_inspection_shuffles_few_columns_a_few_times(spark):
    """With the html at hand, as without; and no join of all nodes with all."""
    made = made_pages(spark, 60).cache()
    nodes = pages.flatten(made).cache()
    got = extract.inspect(made, nodes)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, extract.inspect(made.select("page_id", "url"), nodes).collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 16

"""Queries on page structure. Catalog pages are made by Spark from lineitem
(one page an order, one link a line), chapter pages from conversations (one
page a turn), so that their work grows with those tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, urls
from ..operators import adapt, dom, explore, extract, pages, routing
from ..sources.shared import keep, new_folder
from .queries import _HEADING_TEXT, _TITLE_TEXT, _query, _t


def _nodes(captured):
    return keep(pages.flatten(pages.dealt(captured)))


def _dealt(spark, made):
    """Made pages, written: they are read for their nodes and for their urls."""
    return keep(made)


def _numbers_of_orders(spark, d):
    """The line numbers of each order, each once, in order."""
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("long"))).alias("ns"))


def _made_catalogs(spark, d):
    """One catalog page an order, its lines as chapter links in order."""
    rows, key = _numbers_of_orders(spark, d), F.col("l_orderkey").cast("string")
    link = lambda n: F.concat(F.lit('<li><a href="/book/'), key, F.lit("/"), n.cast("string"), F.lit('.html">第'), n.cast("string"), F.lit("章</a></li>"))
    rows = rows.withColumn("links", F.array_join(F.transform("ns", link), ""))
    html = F.concat(F.lit("<html><head><title>Book "), key, F.lit('</title></head><body><nav><a href="/">Home</a></nav><h1>Book '), key, F.lit('</h1><ul class="chapter-list">'), F.col("links"), F.lit("</ul></body></html>"))
    return rows.select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit("http://shelf.test/book/"), key, F.lit("/")).alias("url"), html.alias("html"))


def _catalog_pages(spark, d):
    return _dealt(spark, _made_catalogs(spark, d))


#: Bits of a page id that hold the turn; the conversation's id takes those above.
_TURN_BITS = 32


def _page_id(turn):
    """An id of its own for each conversation (under 2^31) and turn (under 2^32)."""
    return F.shiftleft(F.col("conv_id").cast("long"), _TURN_BITS) + turn.cast("long")


def _shown_id():
    """The page id as the SQL has it."""
    turn = F.col("page_id").bitwiseAND(F.lit((1 << _TURN_BITS) - 1))
    return (F.shiftright("page_id", _TURN_BITS) * 100_000 + turn).alias("page_id")


def _chapter_pages(spark, d):
    """One chapter page a turn, linked with the ones before and after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = _t(spark, d, "conversations").withColumn("prev", F.lag("turn").over(w)).withColumn("next", F.lead("turn").over(w))
    here = F.concat(F.lit("/book/"), F.col("conv_id").cast("string"), F.lit("/"))
    link = lambda to, label: F.coalesce(F.concat(F.lit('<a href="'), here, F.col(to).cast("string"), F.lit(f'.html">{label}</a>')), F.lit(""))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), text.xml_escape(x), F.lit("</p>")))
    html = F.concat(
        F.lit("<html><head><title>t</title></head><body><h1>第"), F.col("turn").cast("string"), F.lit('章</h1><div id="content"><script>var a;</script>'), F.array_join(lines, ""),
        F.lit('<p class="ad">加入书签</p></div><nav>'), link("prev", "上一章"), F.lit('<a href="'), here, F.lit('">目录</a>'), link("next", "下一章"), F.lit("</nav></body></html>"),
    )
    url = F.concat(F.lit("http://shelf.test"), here, F.col("turn").cast("string"), F.lit(".html"))
    return _dealt(spark, turns.select(_page_id(F.col("turn")).alias("page_id"), "conv_id", "turn", url.alias("url"), html.alias("html")))


_LINES = "(SELECT DISTINCT l_orderkey AS book, l_linenumber AS n FROM lineitem)"


@_query(r"""WITH p AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
n AS (SELECT page_id, 'ads' AS name, len(regexp_extract_all(html, '<div class="ad">')) AS matches FROM p UNION ALL SELECT page_id, 'heading', len(regexp_extract_all(a, '<h1>')) FROM p
UNION ALL SELECT page_id, 'local', len(regexp_extract_all(html, '<a href="/')) FROM p UNION ALL SELECT page_id, 'nav', len(regexp_extract_all(html, '<li><a ')) FROM p UNION ALL SELECT page_id, 'paragraphs', len(regexp_extract_all(a, '<p>')) FROM p)
SELECT page_id, name, matches FROM n WHERE matches > 0""")
def selector_counts(spark, d):
    wanted = {"ads": ".ad", "heading": "article > h1", "local": "a[href^='/']", "nav": "nav li > a", "paragraphs": "article p"}
    return dom.select_all(_nodes(_t(spark, d, "pages")), wanted).select("page_id", "name", "matches")


@_query(rf"""SELECT page_id, 'h1' AS selector, least(length(t), 80)::DOUBLE AS score, 1 AS "rank" FROM
  (SELECT page_id, {_HEADING_TEXT} AS t FROM pages) WHERE t <> ''""")
def title_selectors(spark, d):
    return extract.rank_titles(_nodes(_t(spark, d, "pages")))


@_query()
def structure_fingerprints(spark, d):
    return dom.fingerprints(_nodes(_t(spark, d, "pages")), "salt")


@_query()
def node_paths(spark, d):
    return dom.paths(_nodes(_t(spark, d, "pages"))).select("page_id", "node_id", "selector")


@_query()
def site_inspection(spark, d):
    p = _t(spark, d, "pages")
    return extract.inspect(p, _nodes(p))


@_query("SELECT book AS page_id, row_number() OVER (PARTITION BY book ORDER BY n) AS chapter_index, '第' || n || '章' AS title, 'http://shelf.test/book/' || book || '/' || n || '.html' AS url FROM " + _LINES)
def catalog_chapters(spark, d):
    p = _catalog_pages(spark, d)
    return extract.catalog(pages.links(p, _nodes(p)))


@_query(f"SELECT book AS page_id, '.chapter-list a' AS selector, count(*)::DOUBLE AS score FROM {_LINES} GROUP BY 1 HAVING count(*) >= 3")
def list_selectors(spark, d):
    p = _catalog_pages(spark, d)
    nodes = _nodes(p)
    return extract.rank_lists(nodes, pages.links(p, nodes)).filter("rank = 1").select("page_id", "selector", "score")


_SCORES = f"""WITH l AS (SELECT book, n, lead(n) OVER (PARTITION BY book ORDER BY n) AS nx FROM {_LINES}),
s AS (SELECT book, count(*) AS m, coalesce(avg((nx - n = 1)::INT) FILTER (nx IS NOT NULL), 0) AS c FROM l GROUP BY 1 HAVING count(*) >= 3),
x AS (SELECT book, round((2 * least(1.0, m / 20.0) + 3 * c + 1 + 4) / 10, 6) AS score FROM s)"""


@_query(_SCORES + " SELECT book AS page_id, score FROM x")
def list_scores(spark, d):
    p = _catalog_pages(spark, d)
    kinds = p.select("page_id", F.lit("book_index").alias("kind"))
    c = adapt.context(p, _nodes(p), kinds)
    found = adapt.candidates(c, {"chapter_list": adapt.chapter_lists})
    return adapt.score(c, found).select("page_id", F.round("score", 6).alias("score"))


@_query(_SCORES + """, b AS (SELECT DISTINCT l_orderkey AS book FROM lineitem),
f AS (SELECT b.book, least(coalesce(score, 0), (3 + 2 * 0.7 + least(1.0, length('Book ' || book) / 12.0)) / 6) AS score FROM b LEFT JOIN x USING (book))
SELECT book AS page_id, CASE WHEN score < 0.6 THEN 'reject' WHEN score < 0.85 THEN 'require_confirmation' ELSE 'auto_accept' END AS decision FROM f""")
def page_decisions(spark, d):
    p = _catalog_pages(spark, d)
    kinds = p.select("page_id", F.lit("book_index").alias("kind"))
    c = adapt.context(p, _nodes(p), kinds)
    scored = adapt.score(c, adapt.candidates(c))
    return adapt.decide(kinds, adapt.decide_fields(kinds, scored)).select("page_id", "decision")


@_query("""SELECT conv_id * 100000 + turn AS page_id, field, 'http://shelf.test/book/' || conv_id || '/' || coalesce(k || '.html', '') AS url, 0.7::DOUBLE AS score FROM
(SELECT conv_id, turn, unnest(['prev_link', 'next_link', 'index_link']) AS field, unnest([lag(turn) OVER w, lead(turn) OVER w, NULL]) AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE k IS NOT NULL OR field = 'index_link'""")
def page_navigation(spark, d):
    p = _chapter_pages(spark, d)
    return extract.navigation(extract.anchors(p, _nodes(p))).select(_shown_id(), "field", "url", F.col("score").cast("double").alias("score"))


@_query(r"""SELECT conv_id * 100000 + turn AS page_id, '第' || turn || '章' AS title,
  array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[\s\x{3000}]+', ''), '[\s\x{3000}]+$', '')), lambda x: x <> ''), chr(10)) AS body FROM conversations""")
def chapter_bodies(spark, d):
    return extract.chapters(_nodes(_chapter_pages(spark, d))).select(_shown_id(), "title", "body")


@_query("""SELECT 'http://shelf.test/book/' || conv_id || '/' || min(turn) OVER (PARTITION BY conv_id) || '.html' AS start_url, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
  'http://shelf.test/book/' || conv_id || '/' || turn || '.html' AS url FROM conversations""")
def next_chains(spark, d):
    p = _chapter_pages(spark, d)
    nav = extract.navigation(extract.anchors(p, _nodes(p)))
    urls_of = p.select("page_id", "url")
    following = nav.filter("field = 'next_link'").select("page_id", F.col("url").alias("next_url")).join(urls_of, "page_id").select("url", "next_url")
    starts = p.groupBy("conv_id").agg(F.min_by("url", "turn").alias("url")).select("url")
    return extract.next_chains(starts, following)


@_query("""SELECT conv_id AS book_id, turn // 3 AS chapter_number, coalesce(string_agg(nullif(text, ''), chr(10) ORDER BY turn), '') AS body, count(*) AS pages FROM conversations GROUP BY 1, 2""")
def merged_pages(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.floor(F.col("turn") / 3).alias("chapter_number"), (F.col("turn") % 3 + 1).alias("page_number"), F.col("turn").cast("string").alias("url"), F.col("text").alias("body"))
    return extract.merge_pages(rows)


@_query("SELECT page_id, CASE WHEN regexp_matches(h, '(^|\\.)example\\.(com|org|net)$') AND h IN ('example.com', 'example.org', 'example.net') OR regexp_matches(h, '\\.(test|example|invalid)$') THEN 'local_or_test_url' ELSE 'third_party_crawl_disabled' END AS decision FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS h FROM pages)")
def page_access(spark, d):
    return routing.access(_t(spark, d, "pages")).select("page_id", "decision")


_PATHS = r"(SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)"


@_query(rf"""SELECT page_id, CASE WHEN p <> b AND regexp_replace(p, '[0-9]+(\.html|/)?$', '{{int}}\1') = regexp_replace(b, '[0-9]+(\.html|/)?$', '{{int}}\1') THEN regexp_replace(p, '[0-9]+(\.html|/)?$', '{{int}}\1') END AS template
FROM (SELECT page_id, p, lag(p) OVER (PARTITION BY host ORDER BY page_id) AS b FROM {_PATHS})""")
def sibling_templates(spark, d):
    w = Window.partitionBy("host").orderBy("page_id")
    rows = _t(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.part(F.col("url"), 3).alias("p"))
    return rows.withColumn("b", F.lag("p").over(w)).select("page_id", urls.sibling_template(F.col("b"), F.col("p")).alias("template"))


@_query("SELECT o_custkey AS book_id, i AS \"index\", '第' || i || '章' AS title, 'https://shelf.test/' || o_custkey || '/' || i || '.html' AS url FROM (SELECT o_custkey, unnest(generate_series(1, count(*))) AS i FROM orders GROUP BY 1)")
def sequential_urls(spark, d):
    books = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("book_id")).agg(F.count(F.lit(1)).alias("count")).withColumns({"url": F.lit("https://shelf.test/"), "start": F.lit(1).cast("long")})
    return routing.sequential_urls(books)


@_query(r"""WITH t AS (SELECT conv_id, turn, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[\s\x{3000}]+', ''), '[\s\x{3000}]+$', '')) AS a,
  lag(turn) OVER w IS NOT NULL AS has_prev, lead(turn) OVER w IS NOT NULL AS has_next, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS links FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT *, coalesce(list_sum(list_transform(list_filter(a, lambda x: x <> ''), lambda x: length(x) + 1)), 0) + 4 AS inner_chars FROM t WHERE k <= 3),
s AS (SELECT conv_id, max(links) AS chapter_link_count, count(*) AS sample_count, min(len(a) + 1) AS sample_min_paragraphs, min_by(CASE WHEN inner_chars >= 45 THEN '#content' ELSE 'body' END, k) AS content_selector,
  min(CASE WHEN inner_chars >= 45 THEN inner_chars ELSE inner_chars + 2 + 3 + length(turn::VARCHAR) + 3 + 4 * has_prev::INT + 4 * has_next::INT END) AS sample_min_chars, min(turn) AS first FROM c GROUP BY 1)
SELECT conv_id * 100000 + first AS page_id, 'shelf.test' AS domain, 'http://shelf.test/book/' || conv_id || '/' AS catalog_url, 'h1' AS title_selector, CASE WHEN chapter_link_count >= 2 THEN 'ul.chapter-list a' ELSE 'a' END AS chapter_list_selector,
  chapter_link_count, sample_count::INT AS sample_count, content_selector, sample_min_chars::BIGINT AS sample_min_chars, sample_min_paragraphs::BIGINT AS sample_min_paragraphs,
  concat_ws(',', CASE WHEN chapter_link_count < 2 THEN 'catalog_links_low' END, CASE WHEN sample_min_chars < 200 THEN 'content_short' END) AS warnings, 'shelf' AS site FROM s""")
def exploration_reports(spark, d):
    """Reports written as JSON and read back."""
    found, path = _explored(spark, d), new_folder(spark)
    explore.write_reports(found, path)
    found = spark.read.schema(found.schema).json(path)
    said = F.array_join(F.col("warnings.code"), ",").alias("warnings")
    return found.select(_shown_id(), "domain", "catalog_url", "title_selector", "chapter_list_selector", "chapter_link_count", "sample_count", "content_selector", "sample_min_chars", "sample_min_paragraphs", said, F.col("proposed_config.site").alias("site"))


@_query("""SELECT 'shelf' AS site, 'shelf.test' AS domain, 'h1' AS book_title, CASE WHEN count(*) >= 2 THEN 'ul.chapter-list a' ELSE 'a' END AS chapter_list, 'h1' AS chapter_title, '加入书签' AS last_phrase, 2.0::DOUBLE AS delay_min FROM conversations GROUP BY conv_id""")
def proposed_configs(spark, d):
    """Proposed configs written as JSON and read back."""
    found, path = _explored(spark, d), new_folder(spark)
    explore.write_proposed_configs(found, path)
    c = spark.read.schema(found.select("proposed_config.*").schema).json(path)
    return c.select("site", F.col("domain")[0].alias("domain"), F.col("book.title_selector").alias("book_title"), F.col("book.chapter_list_selector").alias("chapter_list"), F.col("chapter.title_selector").alias("chapter_title"), F.element_at("clean.remove_text_contains", -1).alias("last_phrase"), F.col("request.delay_min").alias("delay_min"))


def _explored(spark, d):
    chapters = _chapter_pages(spark, d)
    label = F.concat(F.lit('<li><a href="'), F.col("turn").cast("string"), F.lit('.html">第'), F.col("turn").cast("string"), F.lit("章</a></li>"))
    book = F.concat(F.lit("http://shelf.test/book/"), F.col("conv_id").cast("string"), F.lit("/"))
    listed = chapters.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", label.alias("a"))))["a"], "").alias("items"))
    html = F.concat(F.lit('<html><head><title>Book</title></head><body><a href="/">Home</a><h1>Book</h1><ul class="chapter-list">'), "items", F.lit("</ul></body></html>"))
    catalogs = listed.select(_page_id(F.lit((1 << _TURN_BITS) - 1)).alias("page_id"), book.alias("url"), html.alias("html"))
    captured = keep(chapters.select("page_id", "url", "html").unionByName(catalogs))
    starts = chapters.groupBy("conv_id").agg(F.min_by("page_id", "turn").alias("page_id"))
    return explore.explore(captured, _nodes(captured), starts)


@_query(rf"""SELECT page_id, 'auto' AS site, coalesce(nullif({_HEADING_TEXT}, ''), nullif(split_part(split_part({_TITLE_TEXT}, '_', 1), '-', 1), ''),
  lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))) AS title, NULL::VARCHAR AS author, url FROM pages""")
def book_infos(spark, d):
    p = _t(spark, d, "pages")
    return extract.book_info(p, _nodes(p))


@_query(r"SELECT page_id, rtrim(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '.') AS domain FROM pages")
def page_domains(spark, d):
    rows = _t(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return urls.canonical_domains(rows).select("page_id", "domain")


@_query("SELECT DISTINCT l_orderkey AS page_id, l_linenumber::BIGINT AS chapter_index, '第' || l_linenumber || '章' AS title, 'https://www.twbook.cc/' || l_orderkey || '/' || l_linenumber || '.html' AS url FROM lineitem")
def numbered_chapters(spark, d):
    key = F.col("l_orderkey").cast("string")
    link = lambda n: F.concat(F.lit('<a href="/'), key, F.lit("/"), n.cast("string"), F.lit('.html"></a><a href="/x/1.html">x</a>'))
    made = _numbers_of_orders(spark, d).select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit("https://www.twbook.cc/"), key, F.lit("/")).alias("url"), F.array_join(F.transform("ns", link), "").alias("html"))
    return extract.numbered_catalog(made, pages.page_links(pages.dealt(made)))


#: (status, html, kind, confidence) of made pages, one of each class and turn of the precedence.
_KINDS = [
    (200, "<title>第一章 启程</title><h1>第一章 启程</h1><article>text</article>", "chapter", 0.95),
    (200, "<title>Book</title><a href='/1'>第一章</a><a href='/2'><b>第二章</b></a><a href='/3'>Chapter 3</a>", "book_index", 0.93),
    (200, "<title>Login</title><form><input type='password'></form>", "auth_or_challenge", 0.98),
    (503, "<title>Just a moment...</title><form action='/captcha'><input name='captcha'></form>", "auth_or_challenge", 0.96),
    (403, "<title>Access Denied</title>", "auth_or_challenge", 0.99),
    (500, "<title>Chapter 1</title><article>text</article>", "error", 1.0),
    (200, "<title>Page not found</title>", "error", 0.9),
    (200, "<title>搜索结果</title><form role='search'></form>", "search_or_list", 0.88),
    (200, "<title>News</title><aside><a href='/1'>第一章</a><a href='/2'>第二章</a><a href='/3'>第三章</a></aside>", "unknown", 0.0),
]


@_query("SELECT o_orderkey AS page_id, CASE o_orderkey % 9 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, _, kind, _) in enumerate(_KINDS)) + " END AS kind, (CASE o_orderkey % 9 " + " ".join(f"WHEN {k} THEN {sure}" for k, (_, _, _, sure) in enumerate(_KINDS)) + " END)::DOUBLE AS confidence FROM orders")
def made_page_kinds(spark, d):
    """One page an order, of the nine shapes in turn."""
    k = F.col("o_orderkey")
    of = lambda at, kind: F.element_at(F.array(*[F.lit(x[at]) for x in _KINDS]), (k % 9 + 1).cast("int")).cast(kind)
    made = _t(spark, d, "orders").select(k.alias("page_id"), F.concat(F.lit("http://shelf.test/"), k.cast("string")).alias("url"), of(0, "int").alias("status_code"), of(1, "string").alias("html"))
    return pages.classify(made, _nodes(made)).select("page_id", "kind", "confidence")


@_query("SELECT book AS page_id, 'shelf.test' AS domain, 'h1' AS title_selector, least(length('Book ' || book), 80)::DOUBLE AS title_score, CASE WHEN m >= 3 THEN '.chapter-list a' END AS list_selector, CASE WHEN m >= 3 THEN m END::DOUBLE AS list_score FROM (SELECT book, count(*) AS m FROM " + _LINES + " GROUP BY 1)")
def catalog_inspections(spark, d):
    p = _catalog_pages(spark, d)
    return extract.inspect(p, _nodes(p)).select("page_id", "domain", "title_selector", "title_score", "list_selector", "list_score")


@_query("""WITH l AS (SELECT book, n, row_number() OVER (PARTITION BY book ORDER BY n) AS k, count(*) OVER (PARTITION BY book) AS m FROM """ + _LINES + """)
SELECT book AS page_id, CASE WHEN m > 1 THEN 'li:nth-of-type(' || k || ') > a' ELSE 'li > a' END AS selector FROM l""")
def link_paths(spark, d):
    """The paths of the chapter links of made catalogs."""
    found = pages.located(pages.dealt(_made_catalogs(spark, d)), lambda tag, attrs: tag == "a" and attrs.get("href", "").startswith("/book/"))
    return found.select("page_id", "selector")


@_query("""WITH l AS (SELECT book, n, row_number() OVER (PARTITION BY book ORDER BY n) AS k, count(*) OVER (PARTITION BY book) AS m FROM """ + _LINES + """)
SELECT book AS page_id, 'dd' AS tag, k, CASE WHEN m = 1 THEN '#item-main' WHEN k = m THEN '.entry.last-item' ELSE 'dd:nth-of-type(' || k || ')' END AS selector FROM l
UNION ALL SELECT book, 'p', k, CASE WHEN m = 1 THEN 'p' ELSE 'dd:nth-of-type(' || k || ') > p' END FROM l""")
def repeated_name_paths(spark, d):
    """The paths of made definition lists, one an order: every definition has
    the same id, all have a class, the last of several a second one; end tags
    are left out."""
    last = lambda k: F.when((k + 1 == F.size("ns")) & (k > 0), " last-item").otherwise("")
    item = lambda n, k: F.concat(F.lit('<dt>x<dd id="item-main" class="entry'), last(k), F.lit('"><p>'), n.cast("string"))
    rows = _numbers_of_orders(spark, d).withColumn("items", F.array_join(F.transform("ns", item), ""))
    made = rows.select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit("<html><body><dl>"), "items", F.lit("</dl></body></html>")).alias("html"))
    found = pages.located(pages.dealt(made), lambda tag, attrs: tag in ("dd", "p"))
    return found.select("page_id", "tag", F.col("nth").cast("long").alias("k"), "selector")


@_query("""SELECT o_orderkey AS page_id, tag, count(*) AS n, min(depth)::INTEGER AS depth FROM orders, (SELECT unnest(['table', 'tr', 'td', 'p', 'li', 'b']) AS tag, unnest([2, 3, 4, 5, 3, 4]) AS depth,
  unnest([1, 2, 3, 3, 2, 2]) AS fixed, unnest([0, 1, 2, 2, 1, 1]) AS each) AS t, (SELECT unnest([0, 1, 2, 3]) AS extra) AS e WHERE extra <= o_orderkey % 4 AND (extra > 0 AND each > 0 OR extra = 0)
GROUP BY o_orderkey, tag""".replace("count(*) AS n", "sum(CASE WHEN extra = 0 THEN fixed ELSE each END)::BIGINT AS n"))
def implied_ends(spark, d):
    """Tags by depth of made pages, one an order, whose rows, cells, paragraphs
    and items all lack their end tags."""
    k = (F.col("o_orderkey") % 4).cast("int")
    cells, items = F.lit("<tr><td><p>a<td><p>b"), F.lit("<li><b>z")
    html = F.concat(F.lit("<html><body><table><tr><td><p>h"), cells, F.repeat(cells, k), F.lit("</table><ul><li><b>x"), items, F.repeat(items, k), F.lit("</ul></body></html>"))
    nodes = _nodes(_dealt(spark, _t(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), html.alias("html"))))
    return nodes.filter(F.col("tag").isin("table", "tr", "td", "p", "li", "b")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("depth"))


@_query("SELECT book AS page_id, count(*) OVER (PARTITION BY m) AS alike FROM (SELECT book, count(*) AS m FROM " + _LINES + " GROUP BY 1)")
def alike_structures(spark, d):
    """How many catalogs have the structure of each: as many links, whatever they say."""
    found = dom.fingerprints(_nodes(_catalog_pages(spark, d)), "salt")
    sizes = found.groupBy("digest").agg(F.count(F.lit(1)).alias("alike"))
    return found.join(sizes, "digest").select("page_id", "alike")


#: Made pages of five kinds of sites: url, html (N: the order's key), title, body.
_SITES = [
    ("https://www.bqg12.cc/book/N/", '<h1>no</h1><div id="title"> TN </div><div id="content"><p>aN</p><p>上一章</p><p class="ad">ad</p><p>bN</p></div>', "TN", "aN\nbN"),
    ("https://www.shuyous.com/book/N-1.html", '<h1 class="title">TN</h1><div class="readCon"><div class="content"><p>aN<b>c</b></p><div class="btnError"><p>zz</p></div><p>bN</p></div></div>', "TN", "aN c\nbN"),
    ("https://www.twbook.cc/N/1.html", '<h1>other</h1><h1 class="imgtext">TN</h1><div class="content"><p>aN<i>c</i></p><p>網站即將改版 N</p><ins><p>ad</p></ins></div>', "TN", "aNc"),
    ("https://m.shelf.test/N", '<h2 class="name">TN</h2><div id="text"><div>aN</div><div>bN</div><form>f</form><div class="share">s</div></div>', "TN", "aN\nbN"),
    ("https://plain.test/N", '<h1>TN</h1><div><p>aN</p><p>bN</p></div>', "TN", "aN\nbN"),
]
_BY_SITE = lambda k: "CASE o_orderkey % 5 " + " ".join(f"WHEN {n} THEN replace('{x[k]}', 'N', o_orderkey::VARCHAR)" for n, x in enumerate(_SITES)) + " END"


@_query(f"SELECT o_orderkey AS page_id, CASE o_orderkey % 5 WHEN 0 THEN 'bqg' WHEN 1 THEN 'shuyous' WHEN 2 THEN 'twbook' WHEN 3 THEN 'shelf' ELSE 'auto' END AS site, {_BY_SITE(2)} AS title, {_BY_SITE(3)} AS body FROM orders")
def site_chapters(spark, d):
    """One page an order, of five kinds of sites, one of them configured."""
    k = F.col("o_orderkey")
    of = lambda at: F.replace(F.element_at(F.array(*[F.lit(x[at]) for x in _SITES]), (k % 5 + 1).cast("int")), F.lit("N"), k.cast("string"))
    made = _dealt(spark, _t(spark, d, "orders").select(k.alias("page_id"), of(0).alias("url"), of(1).alias("html")))
    rules = (*extract.SITE_RULES, extract.configured_rule("shelf", {"chapter_title": ".name", "content": "#text"}, (".share",)))
    return extract.site_chapters(made, _nodes(made), rules, {"shelf.test": "shelf"})


@_query("""SELECT conv_id AS book_id, turn // 3 AS chapter_number, coalesce(string_agg(nullif(text, ''), chr(10) ORDER BY turn DESC), '') AS body, count(*) AS pages FROM conversations GROUP BY 1, 2""")
def followed_pages(spark, d):
    """Turns as pages of chapters of three, linked from the last turn back to
    the first, whose link leads to the last again."""
    w = Window.partitionBy("conv_id", "chapter").orderBy(F.col("turn").desc())
    url = lambda turn: F.concat_ws("/", F.lit("http://shelf.test"), F.col("conv_id").cast("string"), F.col(turn).cast("string"))
    rows = _t(spark, d, "conversations").withColumn("chapter", F.floor(F.col("turn") / 3)).withColumns({"nth": F.row_number().over(w), "onward": F.lead("turn").over(w), "first": F.first("turn").over(w)})
    rows = rows.withColumn("onward", F.coalesce("onward", "first"))
    return extract.merge_followed(rows.select(F.col("conv_id").alias("book_id"), F.col("chapter").alias("chapter_number"), F.col("nth").alias("page_number"), url("turn").alias("url"), url("onward").alias("next_url"), F.col("text").alias("body")))

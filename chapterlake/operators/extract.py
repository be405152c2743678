"""What a page offers: navigation, selector rankings, catalogs, chapters, chains."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, urls
from ..sources.shared import keep, spread
from . import dom, pages, routing

#: Selectors tried in order, and what chapter links look like (fixed values).
TITLE_SELECTORS = ["h1", ".book-title", ".bookname h1", ".info h1", "#info h1", "meta[property='og:novel:book_name']", "meta[property='og:title']"]
CONTENT_SELECTORS = ["#content", ".content", ".chapter-content", ".read-content", ".entry-content", "article", ".text", "#chaptercontent"]
LIST_SELECTORS = [".chapter-list a", ".chapters a", ".listmain a", "#list a", ".book-list a", ".catalog a", "a"]
CHAPTER_LABEL = r"(?i)(第\s*[0-9一二三四五六七八九十百千万零〇两]+\s*[章节回卷集]|chapter\s*\d+)"
CHAPTER_HREF = r"(?i)(/|^)(chapter|chap|read)?[_/-]?\d+\.(html?|xhtml)$|/\d+/?$"
CATALOG_LABELS = ["目录", "返回目录", "章节列表", "书页"]
NEXT_PAGE = "下一页"
#: Labels of navigation links (fixed values).
NAVIGATION = {
    "prev_link": r"(?i)^(?:上一[章节页]|前一[章节页]|previous(?:\s+chapter)?|prev)$",
    "next_link": r"(?i)^(?:下一[章节页]|后一[章节页]|next(?:\s+chapter)?)$",
    "index_link": r"(?i)^(?:目录|章节列表|返回书页|table\s+of\s+contents|contents|index)$",
}
JUNK = "script, style, .ad, .ads, iframe"
#: Pages of one chapter that are joined at most (fixed value).
CHAPTER_PAGES = 20


def anchors(captured: DataFrame, nodes: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """links() with the rel of each anchor."""
    return pages.links(captured, nodes, said, rel=F.lower(F.coalesce(dom.attr("rel"), F.lit(""))))


def navigation(links: DataFrame) -> DataFrame:
    """(page_id, field, node_id, url, score): previous, next and index link of
    each page; a rel token (0.9) goes before a label (0.7), then page order."""
    tokens, label = F.split("rel", r"\s+"), F.regexp_replace("text", r"(?U)\s+", " ")
    by_rel = F.when(F.array_contains(tokens, "prev"), "prev_link").when(F.array_contains(tokens, "next"), "next_link")
    by_label = F.coalesce(*[F.when(label.rlike(pattern), field) for field, pattern in NAVIGATION.items()])
    found = links.withColumn("field", F.coalesce(by_rel, by_label)).filter("field is not null").withColumn("score", F.when(by_rel.isNotNull(), 0.9).otherwise(0.7))
    best = F.min_by(F.struct("node_id", "url", "score"), F.struct(-F.col("score"), "node_id")).alias("b")
    return found.groupBy("page_id", "field").agg(best).select("page_id", "field", "b.*")


def catalog_links(links: DataFrame) -> DataFrame:
    """(page_id, catalog_url, has_next_page) of pages with links."""
    first = F.min_by("url", F.when(F.col("text").isin(*CATALOG_LABELS), F.col("node_id")))
    return links.groupBy("page_id").agg(first.alias("catalog_url"), F.max(F.col("text") == NEXT_PAGE).alias("has_next_page"))


def _top(ranked: DataFrame) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "position")
    return ranked.withColumn("rank", F.row_number().over(w))


def _first_matches(nodes: DataFrame, selectors: list[str]) -> DataFrame:
    """First match of each selector in each page: the node with position and selector."""
    first = Window.partitionBy("page_id", "position").orderBy("node_id")
    return dom.select_each(nodes, selectors).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def rank_titles(nodes: DataFrame) -> DataFrame:
    """(page_id, selector, score, rank): length of the first match's text, 80
    at most; empty ones take no part."""
    first = _first_matches(nodes, TITLE_SELECTORS)
    said = pages.node_text(nodes, first.dropDuplicates(["page_id", "node_id"]), "").withColumnRenamed("text", "said")
    shown = F.when(F.col("tag") == "meta", dom.attr("content")).otherwise(F.col("said"))
    scored = first.join(spread(said), ["page_id", "node_id"], "left").withColumn("score", F.least(F.length(F.coalesce(shown, F.lit(""))), F.lit(80)).cast("double")).filter("score > 0")
    return _top(scored).select("page_id", "selector", "score", "rank")


def rank_contents(nodes: DataFrame) -> DataFrame:
    """(page_id, selector, score, rank): text length plus 100 a paragraph, of
    texts of 100 characters or more; pieces are joined by one character."""
    # a node's text: its pieces and one character between them
    first = _first_matches(nodes, CONTENT_SELECTORS).select("page_id", "node_id", "end_id", "tag", "selector", "position")
    totals = dom.totals_of(nodes, first, chars=F.length("own_text"), pieces=F.col("own_text") != "", paragraphs=F.col("tag") == "p")
    first = first.join(spread(totals), ["page_id", "node_id"])
    size = F.col("chars") + F.greatest(F.col("pieces") - 1, F.lit(0))
    own = (F.col("tag") == "p").cast("long")
    scored = first.withColumn("_size", size).filter("_size >= 100").withColumn("score", (F.col("_size") + (F.col("paragraphs") - own) * 100).cast("double"))
    return _top(scored).select("page_id", "selector", "score", "rank")


def rank_lists(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, selector, score, rank): same-site chapter links of a selector,
    three or more."""
    good = links.filter("same_site").filter(F.col("text").rlike(CHAPTER_LABEL) | F.col("href").rlike(CHAPTER_HREF)).select("page_id", "node_id")
    found = dom.select_each(nodes, LIST_SELECTORS).select("page_id", "node_id", "selector", "position")
    counted = found.join(spread(good), ["page_id", "node_id"]).groupBy("page_id", "selector", "position").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return _top(counted.filter("score >= 3")).select("page_id", "selector", "score", "rank")


def inspect(captured: DataFrame, nodes: DataFrame) -> DataFrame:
    """Best title, content and list selector of every page; null where none.
    Where captured has the html, links are read off it in a pass of their own:
    no texts are shuffled for them."""
    out = captured.select("page_id", urls.domain_of(F.col("url")).alias("domain"))
    links = pages.page_links(pages.dealt(captured)) if "html" in captured.columns else pages.links(captured, nodes)
    ranked = {"title": rank_titles(nodes), "content": rank_contents(nodes), "list": rank_lists(nodes, links)}
    for name, table in ranked.items():
        out = out.join(spread(table.filter("rank = 1").select("page_id", F.col("selector").alias(f"{name}_selector"), F.col("score").alias(f"{name}_score"))), "page_id", "left")
    return out


def largest_block(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, end_id, chars): the block element with most text (its
    pieces and one character after each), the first of equals."""
    sized = dom.subtree_totals(nodes, chars=dom.text_length() + (dom.text_length() > 0).cast("int")).filter(F.col("tag").isin("div", "article", "section", "main"))
    best = F.max_by(F.struct("node_id", "end_id", "chars"), F.struct("chars", -F.col("node_id"))).alias("b")
    return sized.groupBy("page_id").agg(best).select("page_id", "b.*")


def catalog(links: DataFrame, start: int = 1, count: int | None = None) -> DataFrame:
    """(page_id, chapter_index, title, url): chapter links of the page's site,
    the first of each url, numbered in page order; `start` and `count` are a
    window on the index."""
    good = links.filter("same_site").filter(F.col("text").rlike(CHAPTER_LABEL) | F.col("href").rlike(CHAPTER_HREF))
    firsts = good.groupBy("page_id", "url").agg(F.min_by("text", "node_id").alias("title"), F.min("node_id").alias("node_id"))
    order = Window.partitionBy("page_id").orderBy("node_id")
    out = firsts.withColumn("chapter_index", F.row_number().over(order)).filter(F.col("chapter_index") >= start)
    out = out if count is None else out.filter(F.col("chapter_index") < start + count)
    default = F.concat(F.lit("第"), F.col("chapter_index").cast("string"), F.lit("章"))
    return out.select("page_id", "chapter_index", F.coalesce(F.nullif("title", F.lit("")), default).alias("title"), "url")


def chapters(nodes: DataFrame, drop: tuple[str, ...] = (), junk: str = JUNK) -> DataFrame:
    """(page_id, title, body) of every page with a node: junk is cut, the body
    is the paragraphs of the best content node (else of the largest block),
    without promotions and lines that hold one of `drop`."""
    clean = keep(dom.blanked(nodes, dom.select(nodes, junk)))
    ranked = rank_contents(clean).filter("rank = 1").select("page_id", F.col("selector").alias("chosen"))
    hits = _first_matches(clean, CONTENT_SELECTORS).join(ranked, "page_id").filter("selector = chosen").select("page_id", F.col("node_id").alias("_a"), F.col("end_id").alias("_b"))
    block = largest_block(clean).select("page_id", F.col("node_id").alias("_c"), F.col("end_id").alias("_d"))
    root = block.join(hits, "page_id", "full").select("page_id", F.coalesce("_a", "_c").alias("_from"), F.coalesce("_b", "_d").alias("_to"))
    inside = clean.join(root, "page_id").filter("node_id >= _from and node_id <= _to")
    lines = inside.filter(F.col("tag") == "p").select("page_id", "node_id", "end_id")
    bare = root.join(lines.select("page_id").distinct(), "page_id", "left_anti").select("page_id", F.col("_from").alias("node_id"), F.col("_to").alias("end_id"))
    said = pages.node_text(clean, lines.unionByName(bare), "")
    for phrase in drop:
        said = said.filter(~F.col("text").contains(phrase))
    said = said.withColumn("text", text.drop_promotions(F.col("text"))).filter("text <> ''")
    body = said.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("node_id", "text")))["text"], "\n").alias("body"))
    heads = dom.select(clean, "h1").groupBy("page_id").agg(F.min("node_id").alias("node_id"), F.min_by("end_id", "node_id").alias("end_id"))
    titles = pages.node_text(clean, heads, "").select("page_id", F.col("text").alias("title"))
    every = nodes.select("page_id").distinct().join(titles, "page_id", "left").join(body, "page_id", "left")
    return every.select("page_id", F.coalesce("title", F.lit("")).alias("title"), text.normalize_blank_lines(F.coalesce("body", F.lit(""))).alias("body"))


@dataclass(frozen=True)
class SiteRule:
    """How chapters of a site are read: titles and contents are selectors in
    order of preference (each may be a list, whose first match in page order
    counts); junk is cut; the body is the content's paragraphs, each one line
    with its pieces joined by `joint`; without paragraphs, or with `whole`, it
    is the content's text, in lines where `joint` is a line break or `split` is
    set. Lines that hold one of `holding`, or are one of `equal`, go."""

    site: str
    titles: tuple[str, ...]
    contents: tuple[str, ...]
    junk: str
    joint: str = ""
    whole: bool = False
    split: bool = False
    holding: tuple[str, ...] = ()
    equal: tuple[str, ...] = ()
    promotions: bool = False


#: Chapter rules of sites (fixed values).
SITE_RULES = (
    SiteRule("bqg", ("#title",), ("#content", "div.content"), "script, style, .ad, .ads, iframe", split=True, equal=("上一章", "目录", "下一章")),
    SiteRule("shuyous", ("h1.title, .readCon h1, h1",), ("#content, .readCon .content",), "script, style, iframe, .ad, .ads, .spe, .btnError", joint=" ", promotions=True),
    SiteRule("twbook", ("h1.imgtext", "h1"), ("div.content", "#content, .chapter-content, article"), ".adBlock, script, style, ins, iframe", holding=("網站即將改版", "网站即将改版")),
)
#: What is always cut from a configured site's content (fixed value).
CONFIGURED_JUNK = ("script", "style", "noscript", "iframe", "form", "object", "embed")


def configured_rule(site: str, chapter: dict[str, str], clean: tuple[str, ...] = ()) -> SiteRule:
    """The rule of a stored config: its chapter selectors and clean selectors."""
    title = chapter.get("chapter_title") or chapter.get("title")
    return SiteRule(site, (title,) if title else (), (chapter["content"],), ", ".join((*CONFIGURED_JUNK, *clean)), joint="\n", whole=True)


def site_chapters(captured: DataFrame, nodes: DataFrame, rules: tuple[SiteRule, ...] = SITE_RULES, suffixes: dict[str, str] | None = None) -> DataFrame:
    """(page_id, site, title, body) of captured pages (page_id, url): those of a
    site with a rule are read by it, all sites in one pass over the nodes: the
    rules are a table of selectors by site, role and place. Other pages are read
    as chapters() reads them. suffixes gives configured domains their site. A
    page without a content node has an empty body."""
    sites = keep(captured.select("page_id", routing.site_of(F.col("url"), suffixes=suffixes).alias("site")))
    known = [r.site for r in rules]
    own = keep(nodes.join(sites.filter(F.col("site").isin(*known)), "page_id"))
    rows = [(r.site, role, k, s) for r in rules for role, many in (("title", r.titles), ("content", r.contents), ("junk", (r.junk,))) for k, s in enumerate(many)]
    table = captured.sparkSession.createDataFrame(rows, "site string, role string, place int, selector string")  # a few rows a rule
    named = [f.name for f in nodes.schema.fields]
    hits = keep(dom.select_each(own, sorted({s for *_, s in rows})).select("page_id", "node_id", "end_id", "site", "selector").join(F.broadcast(table), ["site", "selector"]))
    clean = keep(dom.blanked(own.select(*named), hits.filter("role = 'junk'")))
    first = lambda role: hits.filter(F.col("role") == role).groupBy("page_id").agg(F.min_by(F.struct("node_id", "end_id"), F.struct("place", "node_id")).alias("f")).select("page_id", "f.*")
    piece = "\u0001"
    titles = pages.node_text(nodes.join(sites, "page_id", "left_semi"), first("title"), "").select("page_id", F.trim("text").alias("title"))

    def of(value, kind):
        """A rule's value by the page's site."""
        out = F.lit(None).cast(kind)
        for r in rules:
            v = value(r)
            out = F.when(F.col("site") == r.site, F.array(*map(F.lit, v)).cast(kind) if isinstance(v, tuple) else F.lit(v)).otherwise(out)
        return out

    root = first("content").join(sites, "page_id")
    inside = clean.join(root.select("page_id", F.col("node_id").alias("_from"), F.col("end_id").alias("_to"), "site"), "page_id").filter("node_id >= _from and node_id <= _to and tag = 'p'")
    lines = inside.filter(~of(lambda r: r.whole, "boolean")).select("page_id", "node_id", "end_id")
    bare = root.select("page_id", "node_id", "end_id").join(lines.select("page_id").distinct(), "page_id", "left_anti")
    said = pages.node_text(clean, lines.withColumn("_bare", F.lit(False)).unionByName(bare.withColumn("_bare", F.lit(True))).drop("_bare"), piece)
    said = said.join(bare.select("page_id", F.lit(True).alias("_bare")), "page_id", "left").join(sites, "page_id")
    joint = F.when(F.col("_bare") & of(lambda r: r.split, "boolean"), "\n").otherwise(of(lambda r: r.joint, "string"))
    parts = said.select("page_id", "site", "node_id", F.posexplode(F.split(F.replace("text", F.lit(piece), joint), "\n")).alias("_k", "line"))
    line = F.trim(F.when(of(lambda r: r.promotions, "boolean"), text.drop_promotions(F.col("line"))).otherwise(F.col("line")))
    parts = parts.withColumn("line", line).filter("line <> ''")
    gone = F.exists(of(lambda r: r.holding, "array<string>"), lambda x: F.col("line").contains(x)) | F.array_contains(of(lambda r: r.equal, "array<string>"), F.col("line"))
    bodies = parts.filter(~F.coalesce(gone, F.lit(False))).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "_k", "line"))), lambda x: x["line"]), "\n").alias("body"))
    ruled = sites.filter(F.col("site").isin(*known)).join(titles, "page_id", "left").join(bodies, "page_id", "left")
    ruled = ruled.select("page_id", "site", F.coalesce("title", F.lit("")).alias("title"), text.normalize_blank_lines(F.coalesce("body", F.lit(""))).alias("body"))
    rest = sites.filter(~F.col("site").isin(*known))
    return ruled.unionByName(chapters(nodes.join(rest, "page_id", "left_semi")).join(rest, "page_id").select("page_id", "site", "title", "body"))


def merge_followed(parts: DataFrame, most: int = CHAPTER_PAGES) -> DataFrame:
    """One body for each chapter of parts (book_id, chapter_number, page_number,
    url, next_url, body): from its first page along the links to pages of the
    same chapter, each met once, `most` pages at most; empty bodies are left out.
    Pages of no book or chapter stand for themselves."""
    own = keep(parts.withColumn("page_number", F.coalesce("page_number", F.lit(1))))
    to = own.select(F.col("url").alias("next_url"), F.col("book_id").alias("_b"), F.col("chapter_number").alias("_c")).distinct()
    following = own.join(to, "next_url").filter("book_id = _b and chapter_number = _c").select("url", "next_url")
    starts = own.groupBy("book_id", "chapter_number").agg(F.min_by("url", F.struct("page_number", "url")).alias("url"))
    chains = next_chains(starts.select("url"), following, most)
    bodies = own.groupBy("url").agg(F.min("body").alias("body"))
    joined = chains.join(bodies, "url").groupBy("start_url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.nullif("body", F.lit("")).alias("body")))), lambda s: s["body"]), "\n").alias("body"), F.count(F.lit(1)).alias("pages"))
    return starts.join(joined, starts["url"] == joined["start_url"]).select("book_id", "chapter_number", "body", "pages")


def merge_pages(parts: DataFrame, most: int = CHAPTER_PAGES) -> DataFrame:
    """One body for each (book_id, chapter_number) of parts with page_number
    and body: the first `most` distinct pages in order, empty bodies left out."""
    each = Window.partitionBy("book_id", "chapter_number", "page_number").orderBy("url")
    order = Window.partitionBy("book_id", "chapter_number").orderBy("page_number")
    once = parts.withColumn("page_number", F.coalesce("page_number", F.lit(1))).withColumn("_n", F.row_number().over(each)).filter("_n = 1").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.nullif("body", F.lit("")).alias("body")))), lambda s: s["body"]), "\n")
    return once.groupBy("book_id", "chapter_number").agg(joined.alias("body"), F.count(F.lit(1)).alias("pages"))


def next_chains(starts: DataFrame, following: DataFrame, limit: int | None = None, increasing: Column | None = None) -> DataFrame:
    """(start_url, position, url): urls met from each start along `following`
    (url, next_url; one row a url) until none follows, one repeats, or `limit`
    where one is given (the rule of twbook has 10,000).

    Jumps double: round k knows, for each url, the urls up to 2^k steps on, so
    a chain of n takes log n rounds. Each round is a kept table: plans stay
    short and a lost executor repeats one round. `increasing` is a condition
    on (url, next_url) without which a link is not followed.
    """
    links = following.filter("next_url is not null and url is not null").groupBy("url").agg(F.min("next_url").alias("next_url"))
    links = keep(links if increasing is None else links.filter(increasing))
    reach, jump = starts.select(F.col("url").alias("start_url"), F.lit(0).cast("long").alias("position"), "url").distinct(), links
    step, known = 1, -1
    while limit is None or step < 2 * limit:
        far = jump.select("url", F.col("next_url").alias("_next"))
        more = reach.join(far, "url").select("start_url", (F.col("position") + step).alias("position"), F.col("_next").alias("url"))
        met = reach.unionByName(more).groupBy("start_url", "url").agg(F.min("position").alias("position")).select("start_url", "position", "url")
        reach = keep(met if limit is None else met.filter(F.col("position") < limit))
        if (now := reach.count()) == known:
            break
        known, step = now, step * 2
        b = jump.select(F.col("url").alias("next_url"), F.col("next_url").alias("_next"))
        jump = keep(jump.join(b, "next_url").select("url", F.col("_next").alias("next_url")))
    return reach


#: Breadcrumb of a book, its author's label, titles where none is found (fixed values).
BREADCRUMB = ".position a[href*='/book/'][href$='.html']"
AUTHOR_LINE = r"作者\s*/\s*([^\n]+)"
DEFAULT_TITLES = {"shuyous": "书友社小说", "twbook": "twbook小说"}


def _text_of(nodes: DataFrame, selector: str, name: str, sep: str = "") -> DataFrame:
    """(page_id, name): text of the first match of a selector, for meta its content."""
    first = dom.select(nodes, selector).groupBy("page_id").agg(F.min_by(F.struct("node_id", "end_id", "tag", dom.attr("content").alias("said")), "node_id").alias("f")).select("page_id", "f.*")
    said = pages.node_text(nodes, first, sep)
    value = F.when(F.col("tag") == "meta", F.trim("said")).otherwise(F.col("text"))
    return first.join(said, ["page_id", "node_id"], "left").select("page_id", F.nullif(value, F.lit("")).alias(name))


def book_info(captured: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, site, title, author, url) of every captured page (page_id,
    url), by the rule of its site: book meta, breadcrumb, heading and a fixed
    title; or the best title selector, the first part of the page's title and
    the host. Author from meta, or from its labelled line; null where none."""
    best = rank_titles(nodes).filter("rank = 1").select("page_id", F.col("selector").alias("chosen"))
    hit = _first_matches(nodes, TITLE_SELECTORS).join(best, "page_id").filter("selector = chosen")
    ranked = hit.join(pages.node_text(nodes, hit, ""), ["page_id", "node_id"], "left").select("page_id", F.nullif(F.when(F.col("tag") == "meta", dom.attr("content")).otherwise(F.col("text")), F.lit("")).alias("ranked"))
    roots = nodes.filter("parent_id is null").select("page_id", "node_id", "end_id")
    whole = pages.node_text(nodes, roots, "\n").groupBy("page_id").agg(F.max(F.nullif(F.regexp_extract("text", AUTHOR_LINE, 1), F.lit(""))).alias("labelled"))
    out = captured.select("page_id", "url", routing.site_of(F.col("url")).alias("site"))
    wanted = {"meta_title": "meta[property='og:novel:book_name']", "meta_author": "meta[property='og:novel:author']", "crumb": BREADCRUMB, "heading": ".chapterBox .name, h1", "high": "h1, h2", "page_title": "title"}
    for table in [ranked, whole, *[_text_of(nodes, s, name) for name, s in wanted.items()]]:
        out = out.join(table, "page_id", "left")
    short = F.nullif(F.substring_index(F.substring_index("page_title", "_", 1), "-", 1), F.lit(""))
    title = (
        F.when(F.col("site") == "shuyous", F.coalesce("meta_title", "crumb", "heading", F.lit(DEFAULT_TITLES["shuyous"]))).when(F.col("site") == "twbook", F.coalesce("high", F.lit(DEFAULT_TITLES["twbook"])))
        .otherwise(F.coalesce("ranked", short, urls.domain_of(F.col("url"))))
    )
    author = F.when(F.col("site") == "shuyous", F.col("meta_author")).when(F.col("site") == "twbook", F.trim("labelled"))
    return out.select("page_id", "site", title.alias("title"), author.alias("author"), "url")


def book_identity(captured: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, identity): the book's meta title, else its breadcrumb, in lower
    case with single blanks; null where a page has neither."""
    out = captured.select("page_id")
    for name, selector in {"meta_title": "meta[property='og:novel:book_name']", "crumb": BREADCRUMB}.items():
        out = out.join(_text_of(nodes, selector, name, " "), "page_id", "left")
    return out.select("page_id", F.trim(F.regexp_replace(F.lower(F.coalesce("meta_title", "crumb")), r"(?U)\s+", " ")).alias("identity"))


def numbered_catalog(captured: DataFrame, links: DataFrame, start: int = 1, count: int | None = None, rules=routing.RULES) -> DataFrame:
    """(page_id, chapter_index, title, url) by the numbers in urls: links to
    chapters of the page's own book, the first of each number, in order;
    `start` is a number, `count` how many from there on."""
    own = keep(routing.url_parts(captured.select("page_id", "url"), rules).select("page_id", F.col("site").alias("own_site"), F.col("book_id").alias("own_book")))
    met = keep(routing.url_parts(links.select("page_id", "node_id", "text", "url"), rules).drop("page_number")).join(own, "page_id").filter("site = own_site and book_id = own_book and chapter_number is not null")
    first = met.groupBy("page_id", "chapter_number").agg(F.min_by(F.struct("text", "url"), "node_id").alias("f")).filter(F.col("chapter_number") >= start)
    if count is not None:
        order = Window.partitionBy("page_id").orderBy("chapter_number")
        first = first.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= count)
    default = F.concat(F.lit("第"), F.col("chapter_number").cast("string"), F.lit("章"))
    return first.select("page_id", F.col("chapter_number").alias("chapter_index"), F.coalesce(F.nullif("f.text", F.lit("")), default).alias("title"), "f.url")


def listed_catalog(payloads: DataFrame, start: int = 1, count: int | None = None) -> DataFrame:
    """(book_id, chapter_index, title, url) of JSON payloads (book_id, host,
    payload) whose `list` holds the titles in order; malformed payloads and
    those without a list give no row. Null titles are empty."""
    got = payloads.withColumn("_list", F.from_json("payload", "list array<string>")["list"])
    rows = got.select("book_id", "host", F.posexplode("_list").alias("_at", "_title")).withColumn("chapter_index", F.col("_at") + 1).filter(F.col("chapter_index") >= start)
    rows = rows if count is None else rows.filter(F.col("chapter_index") < start + count)
    link = F.concat(F.lit("https://"), "host", F.lit("/#/book/"), F.col("book_id").cast("string"), F.lit("/"), F.col("chapter_index").cast("string"), F.lit(".html"))
    return rows.select("book_id", "chapter_index", F.trim(F.coalesce("_title", F.lit(""))).alias("title"), link.alias("url"))

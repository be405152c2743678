"""Reports on sites from sample pages: what a catalog and its first chapters
offer, what to watch for, and a proposed config."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..sources.shared import keep
from . import dom, extract, pages

#: Selectors in order of preference, marks of links and content, limits (fixed values).
BOOK_TITLES = ["meta[property='og:novel:book_name']", "meta[property='og:title']", "h1", ".book-title", ".name"]
AUTHORS = ["meta[property='og:novel:author']", ".author", ".writer", "[class*=author i]", "[class*=writer i]"]
CHAPTER_TITLES = ["h1.title", ".readCon h1", "h1", ".chapter-title"]
LINK_TEXT = r"(?i)(?:第\s*[0-9零一二三四五六七八九十百千万两]+\s*[章节回卷]|chapter\s*\d+)"
LINK_PATH = r"(?i)(?:/book/[^/?#]+-\d+|/chapter/|/\d+\.html|/\d+/?$)"
CONTENT_MARK = r"(?i)(?:content|chapter|read|article|entry|正文)"
CONTENT_TAGS, LIST_TAGS = ("article", "main", "section", "div"), ("div", "section", "ul", "ol")
MIN_CHARS, SHORT_CHARS, SHOWN_LINKS = 45, 200, 20
WARNINGS = {"catalog_links_low": "too few chapter links in the catalog", "content_short": "the sampled texts are short", "chapter_has_pagination": "chapters are spread over pages"}
CLEAN = {"remove_selectors": ["script", "style", "iframe", ".ad", ".ads", ".recommend", ".footer"], "remove_text_contains": ["请收藏本站", "最新网址", "章节错误", "加入书签"]}
REQUEST = {"delay_min": 2.0, "delay_max": 6.0, "retries": 3, "timeout": 25}


def _first_selector(nodes: DataFrame, selectors: list[str], name: str) -> DataFrame:
    """(page_id, name): the first of `selectors` that matches in a page."""
    found = dom.select_all(nodes, {f"{k:02d}": s for k, s in enumerate(selectors)})
    return found.groupBy("page_id").agg(F.min_by("selector", "name").alias(name))


def chapter_links(links: DataFrame) -> DataFrame:
    """(page_id, node_id, title, url, n): chapter links of the page's site, the
    first of each chapter, numbered by the number in the url."""
    good = links.filter("same_site").filter(F.col("text").rlike(LINK_TEXT) | urls.part(F.col("url"), 3).rlike(LINK_PATH))
    first = good.groupBy("page_id", urls.chapter_key(F.col("url")).alias("key")).agg(F.min_by(F.struct("node_id", F.col("text").alias("title"), "url"), "node_id").alias("f"))
    order = Window.partitionBy("page_id").orderBy(urls.chapter_order(F.col("f.url")), F.col("f.node_id"))
    return first.withColumn("n", F.row_number().over(order)).select("page_id", "f.*", "n")


def list_containers(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, chapter_list_selector): the smallest container of two or more
    chapter links, the first of equals."""
    flags = found.select("page_id", "node_id", F.lit(1).alias("_link"))
    counted = dom.subtree_totals(nodes.join(flags, ["page_id", "node_id"], "left"), links=F.coalesce("_link", F.lit(0)))
    holders = counted.filter(F.col("tag").isin(*LIST_TAGS) & (F.col("links") >= 2))
    best = holders.groupBy("page_id").agg(F.min_by("node_id", F.struct("links", "node_id")).alias("node_id"))
    return dom.paths(nodes, best, plain=True).select("page_id", F.concat("selector", F.lit(" a")).alias("chapter_list_selector"))


def contents(nodes: DataFrame) -> DataFrame:
    """(page_id, content_selector, content_chars, paragraphs): the marked block
    of most text, then most paragraphs; the whole body where none has enough."""
    spoken = ~F.col("tag").isin(*dom.SILENT) & (F.col("own_text") != "")
    sized = dom.subtree_totals(nodes, chars=dom.text_length(), pieces=spoken, all_paragraphs=F.col("tag") == "p")
    size = F.col("chars") + F.greatest(F.col("pieces") - 1, F.lit(0))
    sized = sized.withColumns({"content_chars": size, "paragraphs": F.col("all_paragraphs") - (F.col("tag") == "p").cast("long")})
    marked = sized.filter(F.col("tag").isin(*CONTENT_TAGS) & F.concat_ws(" ", dom.attr("id"), dom.attr("class")).rlike(CONTENT_MARK))
    enough = marked.filter((F.col("content_chars") >= MIN_CHARS) & (F.col("paragraphs") >= 1))
    best = keep(enough.groupBy("page_id").agg(F.max_by(F.struct("node_id", "content_chars", "paragraphs"), F.struct("content_chars", "paragraphs", -F.col("node_id"))).alias("b")).select("page_id", "b.*"))
    named = dom.paths(nodes, best, plain=True).select("page_id", "selector").join(best, "page_id")
    whole = sized.filter("parent_id is null").groupBy("page_id").agg(F.sum("chars").alias("c"), F.sum("pieces").alias("k"), F.sum("all_paragraphs").alias("p"))
    joined = whole.join(named, "page_id", "left")
    all_chars = F.col("c") + F.greatest(F.col("k") - 1, F.lit(0))
    return joined.select("page_id", F.coalesce("selector", F.lit("body")).alias("content_selector"), F.coalesce("content_chars", all_chars).alias("content_chars"), F.coalesce("paragraphs", "p").alias("paragraphs"))


def _value(value) -> Column:
    if isinstance(value, list):
        return F.array(*map(F.lit, value))
    return F.struct(*[_value(v).alias(k) for k, v in value.items()]) if isinstance(value, dict) else F.lit(value)


def explore(captured: DataFrame, nodes: DataFrame, starts: DataFrame, sample: int = 3) -> DataFrame:
    """One report for each start page (page_id) of captured pages (page_id,
    url, html). The catalog is the page that a catalog link of the start leads
    to, else the start; the first `sample` (1 to 5) of its chapters that are
    captured are the samples. Starts whose catalog is not captured have no
    report. Of pages captured twice under a url the smaller id counts."""
    if not 1 <= sample <= 5:
        raise ValueError("sample must be from 1 to 5")
    links = keep(pages.links(captured, nodes))
    labels = extract.catalog_links(links)
    by_url = captured.groupBy("url").agg(F.min("page_id").alias("id"))
    begun = starts.select("page_id").distinct().join(captured.select("page_id", F.col("url").alias("source_url")), "page_id").join(labels, "page_id", "left")
    begun = begun.select(F.col("page_id").alias("start_id"), "source_url", F.coalesce("catalog_url", "source_url").alias("catalog_url"))
    begun = keep(begun.join(by_url.select(F.col("url").alias("catalog_url"), F.col("id").alias("page_id")), "catalog_url"))
    chosen = begun.select("page_id").distinct()
    of_catalog = nodes.join(chosen, "page_id", "left_semi")
    found = keep(chapter_links(links.join(chosen, "page_id", "left_semi")))

    shown = F.filter(F.array_sort(F.collect_list(F.when(F.col("n") <= SHOWN_LINKS, F.struct("n", "title", "url")))), lambda x: x.isNotNull())
    listed = found.groupBy("page_id").agg(F.count(F.lit(1)).alias("chapter_link_count"), F.transform(shown, lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("chapter_links"))
    sampled = found.filter(F.col("n") <= sample).select(F.col("page_id").alias("catalog_id"), "n", "url").join(by_url, "url").withColumnRenamed("id", "page_id")
    sampled = keep(sampled)
    of_samples = nodes.join(sampled.select("page_id").distinct(), "page_id", "left_semi")
    read = sampled.join(contents(of_samples), "page_id", "left").join(_first_selector(of_samples, CHAPTER_TITLES, "title_selector"), "page_id", "left").join(labels.select("page_id", "has_next_page"), "page_id", "left")
    row = F.struct("n", "url", F.coalesce("title_selector", F.lit("")).alias("title_selector"), F.coalesce("content_selector", F.lit("body")).alias("content_selector"), F.coalesce("content_chars", F.lit(0)).alias("content_chars"), F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"), F.coalesce("has_next_page", F.lit(False)).alias("has_next_page"))
    read = read.groupBy(F.col("catalog_id").alias("page_id")).agg(F.array_sort(F.collect_list(row)).alias("samples"))

    out = begun.join(listed, "page_id", "left").join(read, "page_id", "left").join(list_containers(of_catalog, found), "page_id", "left")
    out = out.join(_first_selector(of_catalog, BOOK_TITLES, "title_selector"), "page_id", "left").join(_first_selector(of_catalog, AUTHORS, "author_selector"), "page_id", "left")
    samples = F.coalesce("samples", F.array().cast(read.schema["samples"].dataType))
    first = lambda name: F.coalesce(F.get(F.filter(F.transform("samples", lambda s: s[name]), lambda s: s != ""), F.lit(0)), F.lit(""))
    out = out.withColumns({"samples": samples, "domain": urls.host(F.col("catalog_url")), "chapter_link_count": F.coalesce("chapter_link_count", F.lit(0).cast("long")), "chapter_list_selector": F.coalesce("chapter_list_selector", F.lit("a")), "chapter_links": F.coalesce("chapter_links", F.array().cast(listed.schema["chapter_links"].dataType))})
    out = out.withColumns({
        "sample_count": F.size("samples"), "chapter_title_selector": first("title_selector"), "content_selector": first("content_selector"),
        "sample_min_chars": F.coalesce(F.array_min("samples.content_chars"), F.lit(0).cast("long")), "sample_min_paragraphs": F.coalesce(F.array_min("samples.paragraphs"), F.lit(0).cast("long")), "has_paginated_chapter": F.exists("samples", lambda s: s["has_next_page"]),
    })
    tests = {"catalog_links_low": F.col("chapter_link_count") < 2, "content_short": F.col("sample_min_chars") < SHORT_CHARS, "chapter_has_pagination": F.col("has_paginated_chapter")}
    warned = [F.when(t, F.struct(F.lit(code).alias("code"), F.lit(WARNINGS[code]).alias("message"))) for code, t in tests.items()]
    or_else = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    config = F.struct(
        F.substring_index("domain", ".", 1).alias("site"), F.array("domain").alias("domain"),
        F.struct(or_else("title_selector", "h1").alias("title_selector"), or_else("author_selector", ".author").alias("author_selector"), "chapter_list_selector").alias("book"),
        F.struct(or_else("chapter_title_selector", "h1").alias("title_selector"), or_else("content_selector", "body").alias("content_selector"), F.lit("p").alias("paragraph_selector")).alias("chapter"),
        _value(CLEAN).alias("clean"), _value(REQUEST).alias("request"),
    )
    return out.select(
        F.col("start_id").alias("page_id"), "source_url", "domain", "catalog_url", F.coalesce("title_selector", F.lit("")).alias("title_selector"), F.coalesce("author_selector", F.lit("")).alias("author_selector"),
        "chapter_list_selector", "chapter_link_count", "chapter_links", "sample_count", "samples", "chapter_title_selector", "content_selector", "sample_min_chars", "sample_min_paragraphs", "has_paginated_chapter",
        F.filter(F.array(*warned), lambda w: w.isNotNull()).alias("warnings"), F.col("has_paginated_chapter").alias("requires_dedicated_adapter"), config.alias("proposed_config"),
    )


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def write_proposed_configs(reports: DataFrame, path: str) -> None:
    reports.select("proposed_config.*").write.mode("overwrite").json(path)

"""Site rules: which rule handles a URL, and what its URLs say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

#: Site rules in order: name, host pattern, patterns of book id, chapter number
#: and page number in a URL's path (fixed values).
RULES = (
    ("bqg", r"^(?:www\.)?bqg\d+\.(?:cc|xyz)$", r"book/(\d+)", "", ""),
    ("shuyous", r"^(?:www\.)?shuyous\.com$", r"/book/(\d+)(?:[-.]|$)", r"^/book/\d+-(\d+)(?:-\d+)?\.html$", r"^/book/\d+-\d+-(\d+)\.html$"),
    ("twbook", r"^(?:www\.)?twbook\.cc$", r"^/(\d+)", r"^/\d+/(\d+)\.html$", ""),
)
FALLBACK = "auto"


def site_of(url: Column, rules=RULES, suffixes: dict[str, str] | None = None) -> Column:
    """Name of the first rule whose host pattern fits; then of the first given
    domain that is the host or ends it; else auto. Null URLs are auto."""
    return _site_of_host(urls.host(url), rules, suffixes)


def _site_of_host(host: Column, rules, suffixes: dict[str, str] | None = None) -> Column:
    out = F.when(F.lit(False), FALLBACK)
    for name, pattern, *_ in rules:
        out = out.when(host.rlike("(?i)" + pattern), name)
    for domain, name in (suffixes or {}).items():
        out = out.when((host == domain) | host.endswith("." + domain), name)
    return out.otherwise(FALLBACK)


def url_parts(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds site, book_id, chapter_number, page_number (null where a rule has
    none). Host and path are columns of their own, so that each is read off a
    url once; filters on what is added would read them again for each: keep it
    first."""
    path = F.col("_path")

    def found(k):
        out = F.lit(None).cast("string")
        for rule in rules:
            if rule[k]:
                out = F.when(F.col("site") == rule[0], F.nullif(F.regexp_extract(path, rule[k], 1), F.lit(""))).otherwise(out)
        return out

    routed = pages.withColumns({"_host": urls.host(F.col("url")), "_path": urls.part(F.col("url"), 3)}).withColumn("site", _site_of_host(F.col("_host"), rules))
    return routed.withColumns({"book_id": found(2), "chapter_number": found(3).try_cast("long"), "page_number": found(4).try_cast("long")}).drop("_host", "_path")


def sequential_urls(books: DataFrame) -> DataFrame:
    """One row for each chapter of books (book_id, url, start, count): index,
    title and generated url. Null or non-positive counts give no row."""
    wanted = books.filter("count > 0").withColumn("index", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)))
    site = F.concat(F.coalesce(F.nullif(urls.part(F.col("url"), 1), F.lit("")), F.lit("https")), F.lit("://"), urls.part(F.col("url"), 2))
    link = F.concat(site, F.lit("/"), F.col("book_id").cast("string"), F.lit("/"), F.col("index").cast("string"), F.lit(".html"))
    return wanted.select("book_id", "index", F.concat(F.lit("第"), F.col("index").cast("string"), F.lit("章")).alias("title"), link.alias("url"))


def access(pages: DataFrame) -> DataFrame:
    return pages.withColumn("decision", urls.access_decision(F.col("url")))

"""Stored site configs: checks, revisions, and the one for a URL.

configs: config_id, site, domain, version, status, validated, url_patterns
(array), selectors (struct of clean array, book map, chapter map),
request_policy (struct), field_scores (map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls

#: Shapes of ids, score names and secrets; limits of request policies (fixed values).
CONFIG_ID = r"^cfg_[A-Za-z0-9_-]{16,80}$"
NAME = r"^[a-z][a-z0-9_.-]{0,79}$"
SECRET = r"(?i)token|secret|password|passwd|api[_-]?key|session|authorization"
UNSAFE_SELECTOR = r"(?i):has\s*\(|:contains\s*\(|:-soup-contains(?:-own)?\s*\(|https?://|@|[?&]|token|secret|password|session"
SELECTORS, SELECTOR_CHARS, SELECTOR_LENGTH, JOINTS = 20, 4096, 512, 3
TIMEOUT, RETRIES, RATE = 120, 10, 60


def _found(tests: list[tuple[str, Column]]) -> Column:
    """Names of the tests that hold; a null test holds."""
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(True)), name) for name, t in tests]), lambda x: x.isNotNull())


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def check(configs: DataFrame) -> DataFrame:
    """Adds errors (no site, domain or content selector) and warnings (other
    selectors unset)."""
    book, chapter = F.col("selectors.book"), F.col("selectors.chapter")
    errors = _found([("site", _blank(F.col("site"))), ("domain", _blank(F.col("domain"))), ("chapter.content", _blank(chapter["content"]))])
    warnings = _found([("book.title", _blank(book["title"])), ("book.chapter_list", _blank(book["chapter_list"])), ("chapter.paragraph", _blank(chapter["paragraph"]))])
    return configs.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("valid", F.size("errors") == 0)


def strict_errors(configs: DataFrame) -> DataFrame:
    """Adds errors: names of the strict rules that a config breaks."""
    clean = F.coalesce("selectors.clean", F.array().cast("array<string>"))
    held = lambda m: F.coalesce(F.map_values(m), F.array().cast("array<string>"))
    chosen = F.concat(clean, held(F.col("selectors.book")), held(F.col("selectors.chapter")))
    joints = lambda s: F.size(F.regexp_extract_all(s, F.lit(r"(\s+|[>+~])"), 1))
    bad_selector = F.exists(chosen, lambda s: F.coalesce((s == "") | (F.length(s) > SELECTOR_LENGTH) | s.rlike(UNSAFE_SELECTOR) | (joints(s) > JOINTS), F.lit(True)))
    pattern = lambda p: urls.pattern_regex(p).isNull() | p.rlike(SECRET) | (p.startswith("https://") & (urls.host(p) != F.col("domain")))
    policy, scores = F.col("request_policy"), F.col("field_scores")
    between = lambda c, low, high: ~c.between(low, high)
    tests = [
        ("config_id", ~F.col("config_id").rlike(CONFIG_ID)),
        ("domain", ~F.col("domain").rlike(r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+$") | (F.length("domain") > 253)),
        ("url_patterns", (F.size("url_patterns") == 0) | F.exists("url_patterns", lambda p: F.coalesce(pattern(p), F.lit(True)))),
        ("selectors", bad_selector | (F.size(chosen) > SELECTORS) | (F.aggregate(chosen, F.lit(0), lambda a, s: a + F.length(s)) > SELECTOR_CHARS)),
        ("selector_names", F.exists(F.concat(F.map_keys("selectors.book"), F.map_keys("selectors.chapter")), lambda k: ~k.rlike(NAME))),
        ("timeout_seconds", (policy["timeout_seconds"] <= 0) | between(policy["timeout_seconds"], 0, TIMEOUT)), ("max_retries", between(policy["max_retries"], 0, RETRIES)), ("rate_limit_seconds", between(policy["rate_limit_seconds"], 0, RATE)),
        ("field_scores", F.exists(F.map_keys(scores), lambda k: ~k.rlike(NAME)) | F.exists(F.map_values(scores), lambda v: F.coalesce(F.isnan(v) | ~v.between(0, 1), F.lit(True)))),
    ]
    return configs.withColumn("errors", _found(tests))


def latest(configs: DataFrame) -> DataFrame:
    """The highest version of each config."""
    w = Window.partitionBy("config_id").orderBy(F.col("version").desc())
    return configs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def status_history(configs: DataFrame) -> DataFrame:
    """Each revision with the status before it, where it differs."""
    w = Window.partitionBy("config_id").orderBy("version")
    return configs.withColumn("previous", F.lag("status").over(w)).filter(~F.col("previous").eqNullSafe(F.col("status"))).select("config_id", "version", "previous", "status")


def _segments(path: Column) -> Column:
    return F.split(F.substr(path, F.lit(2)), "/")


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """Adds shape and key to patterns (pattern): the shape has `=` for each
    literal segment and `*` for each other, and `+` where a final `**` takes the
    rest; the key has the literal segments."""
    parts = _segments(urls.part(F.concat(F.when(F.col("pattern").startswith("/"), "https://h").otherwise(""), "pattern"), 3))
    open_ = F.element_at("_parts", -1) == "**"
    literal = lambda s: ~(s.contains("{") | (s == "*"))
    fixed = patterns.withColumn("_parts", parts).withColumn("_open", open_)
    fixed = fixed.withColumn("_parts", F.when(F.col("_open"), F.slice("_parts", F.lit(1), F.size("_parts") - 1)).otherwise(F.col("_parts")))
    shape = F.concat(F.array_join(F.transform("_parts", lambda s: F.when(literal(s), "=").otherwise("*")), ""), F.when(F.col("_open"), "+").otherwise(""))
    key = F.array_join(F.transform("_parts", lambda s: F.when(literal(s), s).otherwise("*")), "/")
    return fixed.withColumns({"shape": shape, "key": key}).drop("_parts", "_open")


def page_keys(asked: DataFrame, shapes: DataFrame) -> DataFrame:
    """asked (domain, url) with each shape that patterns of its domain have and
    its path can fill, and the key of its path in that shape. The shapes of a
    domain are few: they lie in one row."""
    of_domain = shapes.groupBy("domain").agg(F.collect_set("shape").alias("_shapes"))
    path = urls.canonical_path(F.coalesce(F.nullif(urls.part(F.col("url"), 3), F.lit("")), F.lit("/")))
    joined = asked.join(of_domain, "domain").withColumn("_parts", _segments(path)).select("*", F.explode("_shapes").alias("shape")).drop("_shapes")
    size, open_ = F.length("shape"), F.col("shape").endswith("+")
    fits = F.when(open_, F.size("_parts") >= size).otherwise(F.size("_parts") == size)
    own = F.slice("_parts", F.lit(1), size - F.when(open_, 1).otherwise(0))
    key = F.array_join(F.transform(own, lambda s, i: F.when(F.substr("shape", i + 1, F.lit(1)) == "=", s).otherwise("*")), "/")
    return joined.filter(fits).withColumn("key", key).drop("_parts")


def active_for(pages: DataFrame, configs: DataFrame) -> DataFrame:
    """(page_id, config_id): the active config of each page's domain one of
    whose patterns fits its url; the best by (validated, version, id). Pages
    meet patterns by equal keys (domain, shape, literal segments); only those
    are tried."""
    live = latest(configs).filter("status = 'active'").select(F.col("domain"), "config_id", "version", "validated", F.explode("url_patterns").alias("pattern"))
    live = pattern_keys(live)
    asked = pages.select("page_id", "url", urls.host(F.col("url")).alias("domain")).filter(F.coalesce(urls.valid_url(F.col("url")), F.lit(False)))
    met = page_keys(asked, live.select("domain", "shape")).join(live, ["domain", "shape", "key"]).filter(urls.pattern_matches(F.col("url"), F.col("pattern")))
    return met.groupBy("page_id").agg(F.max_by("config_id", F.struct("validated", "version", "config_id")).alias("config_id"))

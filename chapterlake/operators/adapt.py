"""Finding a site's fields: candidates, scores, decisions, configs.

A candidate is a node that may hold a field of its page. Rules, scores and
decisions are tables over candidates; node texts and totals come from joins
and running sums on the node table, so no page is parsed again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, urls
from ..sources.shared import keep, spread
from . import dom, extract, pages

#: Chapter labels of candidates and of scores (fixed values).
CHAPTER = (
    r"(?i)第\s*[0-9零一二三四五六七八九十百千万两]+(?:\.[0-9]+)?\s*[章节回卷]|(?:chapter|part|book)\s+(?:\d+(?:\.\d+)?|[ivxlcdm]+)\b|\b(?:prologue|epilogue|foreword|afterword|interlude)\b"
    r"|chapter\s+(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand)\b|序章|楔子|番外"
)
SCORED_CHAPTER = r"(?i)第\s*[0-9零一二三四五六七八九十百千万两]+\s*[章节回卷]|chapter\s+(?:\d+|[a-z -]+)|part\s+(?:\d+|[ivxlcdm]+)|prologue|epilogue|foreword|afterword|interlude|序章|楔子|番外"
CONTENT_HINT = r"(?i)content|article|chapter|reader|read|正文|内容"
BLOCKS = ("article", "main", "section", "div")
LISTS = ("div", "section", "ul", "ol", "main")
#: Least chapter links and characters of a candidate; targets of scores;
#: thresholds of decisions (fixed values).
MIN_LINKS, MIN_CHARS = 3, 45
TARGET_LINKS, TARGET_CHARS, TARGET_PARAGRAPHS = 20, 1000, 8
HIGH, MEDIUM, MARGIN = 0.85, 0.60, 0.03
#: Fields a page of a kind must have, and codes of kinds that are refused (fixed values).
REQUIRED = {"book_index": ("title", "chapter_list"), "chapter": ("chapter_title", "content")}
REFUSED = {"auth_or_challenge": "auth_required", "error": "error_page", "unknown": "unsupported_page", "search_or_list": "unsupported_page"}


@dataclass
class Context:
    """nodes: with selector, text totals and noise flags; links: anchors with
    href; said: texts of the nodes that rules look at; kinds: page_id, kind."""

    nodes: DataFrame
    links: DataFrame
    said: DataFrame
    kinds: DataFrame


def context(captured: DataFrame, nodes: DataFrame, kinds: DataFrame) -> Context:
    """Lays out once what rules and scores read of pages (page_id, url, html);
    the tables are written, so that no rule works them out again."""
    hinted = F.col("tag").isin("h1", "h2", "title", "p", "span") | dom.marker().rlike("(?i)author|writer")
    texts = keep(pages.node_text(nodes, nodes.filter(hinted | (F.col("tag") == "a")).withColumn("_hinted", hinted), keeping=["_hinted"]))
    links = keep(extract.anchors(captured, nodes, texts))
    good = links.filter(F.col("text").rlike(CHAPTER)).select("page_id", "node_id")
    said, shown = F.col("own_text") != "", F.length("own_text")
    sums = {"chars": shown, "pieces": said, "link_chars": F.when(F.col("tag") == "a", shown).otherwise(0)}
    outside = {"clean_chars": shown, "clean_pieces": said, "paragraphs": F.col("tag") == "p"}
    totals = dom.laid_out(nodes, dom.is_noise(), good, sums, outside).withColumnRenamed("marks", "chapter_links")
    return Context(keep(totals), links, texts.filter("_hinted").drop("_hinted"), keep(kinds.select("page_id", "kind")))


def _row(df: DataFrame, field: Column, score: Column, rule: str) -> DataFrame:
    return df.select("page_id", field.alias("field"), "node_id", "selector", score.cast("double").alias("raw_score"), F.lit(rule).alias("rule"))


def headings(c: Context) -> DataFrame:
    found = c.nodes.filter(F.col("tag").isin("h1", "h2", "title")).join(c.said, ["page_id", "node_id"]).join(c.kinds, "page_id")
    titled = (F.col("kind") == "chapter") & F.col("text").rlike(CHAPTER)
    found = found.withColumn("field", F.when(titled, "chapter_title").otherwise("title")).withColumn("bucket", text.length_bucket(F.length("text")))
    first = Window.partitionBy("page_id", "field", "bucket").orderBy("node_id")
    found = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    score = F.when(F.col("tag") == "h1", 0.9).otherwise(0.65) + F.when(F.col("field") == "chapter_title", 0.15).otherwise(0.0)
    return _row(found, F.col("field"), score, "heading")


def authors(c: Context) -> DataFrame:
    texts = c.nodes.join(c.said, ["page_id", "node_id"])
    labelled = texts.filter(text.author_of(F.col("text")).isNotNull())
    alone = c.nodes.filter(F.col("own_text").rlike(r"^\s*作者\s*[：:]?\s*$")).select("page_id", "parent_id", (F.col("end_id") + 1).alias("node_id"))
    beside = c.nodes.join(alone, ["page_id", "parent_id", "node_id"], "left_semi").filter("chars > 0")
    return _row(labelled, F.lit("author"), F.lit(0.85), "author.label").unionByName(_row(beside, F.lit("author"), F.lit(0.75), "author.sibling"))


def chapter_lists(c: Context) -> DataFrame:
    """Containers outside noise of MIN_LINKS chapter links or more, not those
    that are the parent of one."""
    boxes = c.nodes.filter(F.col("tag").isin(*LISTS) & ~F.col("noise") & (F.col("chapter_links") >= MIN_LINKS))
    outer = boxes.select("page_id", F.col("parent_id").alias("node_id"))
    inner = boxes.join(outer, ["page_id", "node_id"], "left_anti")
    return _row(inner, F.lit("chapter_list"), 0.55 + F.least(F.col("chapter_links"), F.lit(10)) * 0.04, "chapter_list").withColumn("selector", F.concat("selector", F.lit(" a")))


def contents(c: Context) -> DataFrame:
    chars = F.col("clean_chars") + F.greatest(F.col("clean_pieces") - 1, F.lit(0))
    hint = (F.col("tag") == "article") | F.concat_ws(" ", dom.attr("id"), dom.attr("class")).rlike(CONTENT_HINT)
    boxes = c.nodes.filter(F.col("tag").isin(*BLOCKS) & ~F.col("noise")).join(c.kinds.filter("kind = 'chapter'"), "page_id", "left_semi")
    good = boxes.filter((chars >= MIN_CHARS) & (hint | (F.col("paragraphs") >= 2)))
    return _row(good, F.lit("content"), F.least(F.lit(1.2), 0.35 + chars / 500 + F.col("paragraphs") * 0.12 + F.when(hint, 0.25).otherwise(0.0)), "content")


def navigation(c: Context) -> DataFrame:
    label = F.regexp_replace("text", r"(?U)\s+", " ")
    tokens = F.split("rel", r"\s+")
    by_rel = F.when(F.array_contains(tokens, "prev"), "prev_link").when(F.array_contains(tokens, "next"), "next_link")
    by_label = F.coalesce(*[F.when(label.rlike(p), f) for f, p in extract.NAVIGATION.items()])
    found = c.links.withColumn("field", F.coalesce(by_rel, by_label)).filter("field is not null").withColumn("_s", F.when(by_rel.isNotNull(), 0.9).otherwise(0.7))
    return _row(found.join(c.nodes.select("page_id", "node_id", "selector"), ["page_id", "node_id"]), F.col("field"), F.col("_s"), "navigation")


def noise(c: Context) -> DataFrame:
    return _row(c.nodes.filter(dom.is_noise()), F.lit("clean_selector"), F.lit(0.85), "noise")


#: Rules by name; a caller may add its own: Context -> candidates.
RULES: dict[str, Callable[[Context], DataFrame]] = {"heading": headings, "author": authors, "chapter_list": chapter_lists, "content": contents, "navigation": navigation, "noise": noise}


def candidates(c: Context, rules: dict[str, Callable[[Context], DataFrame]] = RULES) -> DataFrame:
    """page_id, field, node_id, selector, raw_score, rule."""
    return reduce(DataFrame.unionByName, [rule(c) for rule in rules.values()])


def list_features(c: Context, found: DataFrame) -> DataFrame:
    """Of each chapter list: count and share of chapter labels, share of its
    links on the page's site, and continuity: the share of neighbouring links
    whose number grows by one. A list's links are a run of its page's links in
    order: running sums where it begins and ends give all of these."""
    boxes = found.filter("field = 'chapter_list'").select("page_id", "node_id").distinct().join(c.nodes.select("page_id", "node_id", "end_id"), ["page_id", "node_id"])
    number = text.link_number(F.col("text"), F.col("href"))
    linked = c.links.select("page_id", F.col("node_id").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("box"), number.alias("number"), F.col("text").rlike(SCORED_CHAPTER).cast("int").alias("label"), F.col("same_site").cast("int").alias("same"))
    onward = Window.partitionBy("page_id").orderBy("at")
    linked = linked.withColumn("grows", F.coalesce((F.lead("number").over(onward) - F.col("number") == 1).cast("int"), F.lit(0))).drop("number")
    mark = lambda at, kind: boxes.select("page_id", F.col(at).alias("at"), F.lit(kind).alias("kind"), F.col("node_id").alias("box"))
    marks = linked.unionByName(mark("node_id", 2).unionByName(mark("end_id", 3)), allowMissingColumns=True)
    order = Window.partitionBy("page_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"links": F.count_if(F.col("kind") == 1), "labels": F.sum(F.coalesce("label", F.lit(0))), "own": F.sum(F.coalesce("same", F.lit(0))), "steps": F.sum(F.coalesce("grows", F.lit(0)))}
    met = marks.withColumns({n: f.over(order) for n, f in sums.items()} | {"last": F.last("grows", ignorenulls=True).over(order)}).filter("kind > 1")
    begin, end = (lambda n: F.min(F.when(F.col("kind") == 2, F.col(n)))), (lambda n: F.max(F.when(F.col("kind") == 3, F.col(n))))
    each = met.groupBy("page_id", F.col("box").alias("node_id")).agg(*[(end(n) - begin(n)).alias(n) for n in sums], end("last").alias("last"))
    share = lambda n: F.col(n) / F.col("links")
    steps = F.when(F.col("links") > 1, (F.col("steps") - F.col("last")) / (F.col("links") - 1)).otherwise(0.0)
    return each.filter("links > 0").select("page_id", "node_id", F.col("labels").cast("double").alias("count"), share("labels").alias("precision"), share("own").alias("same_origin"), steps.alias("continuity"))


def _length_score(n: Column, low: int, high: int) -> Column:
    return F.when(n.between(low, high), F.least(F.lit(1.0), n / 12)).otherwise(0.0)


def _weighted(field: str, parts: list[tuple[str, Column, float]]) -> Column:
    clean = lambda s: F.coalesce(F.least(F.greatest(s.cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return F.array(*[F.struct(F.lit(f"{field}.{name}").alias("id"), clean(score).alias("score"), F.lit(float(weight)).alias("weight")) for name, score, weight in parts])


def check_rules(rules: dict[str, list[tuple[str, Column, float]]]) -> None:
    """Raises ValueError unless names differ within a field and weights are above 0."""
    for field, parts in rules.items():
        names = [name for name, _, _ in parts]
        if not names or len(set(names)) < len(names) or any(not weight > 0 for _, _, weight in parts):
            raise ValueError(f"scoring rules of {field} need names of their own and weights above 0")


def weighted_score(components: Column) -> Column:
    total = lambda f: F.aggregate(components, F.lit(0.0), lambda a, x: a + f(x))
    return total(lambda x: x["score"] * x["weight"]) / total(lambda x: x["weight"])


def score(c: Context, found: DataFrame, rules: dict[str, list[tuple[str, Column, float]]] | None = None) -> DataFrame:
    """Adds components, score and rank (in page and field: best score, then
    selector). Fields are not compared with each other. `rules` gives a caller's
    components of a field, (name, score, weight) over the columns of found, its
    nodes and features, in place of the field's own."""
    check_rules(rules or {})
    found = keep(found)
    nodes = c.nodes.select("page_id", "node_id", "tag", "attrs", "noise", "chars", "pieces", "clean_chars", "clean_pieces", "paragraphs", "link_chars")
    anchors = c.links.select("page_id", "node_id", F.col("text").alias("label"), "rel")
    many = c.links.groupBy("page_id").agg(F.count(F.lit(1)).alias("anchors"))
    joined = found.join(nodes, ["page_id", "node_id"]).join(c.said, ["page_id", "node_id"], "left").join(anchors, ["page_id", "node_id"], "left")
    joined = joined.join(many, "page_id", "left").join(spread(list_features(c, found)), ["page_id", "node_id"], "left").join(c.kinds, "page_id", "left")
    size, tag, kind = F.coalesce(F.length("text"), F.lit(0)), F.col("tag"), F.col("kind")
    whole = F.col("chars") + F.greatest(F.col("pieces") - 1, F.lit(0))
    clean = F.col("clean_chars") + F.greatest(F.col("clean_pieces") - 1, F.lit(0))
    fits = tag.isin(*BLOCKS) & ~F.col("noise") & (clean >= 45) & (F.col("paragraphs") > 0)
    dom_score = lambda h1, title, h2: F.when(tag == "h1", h1).when(tag == "title", title).when(tag == "h2", h2).otherwise(0.0)
    fielded = lambda name: F.concat(F.element_at(F.split(F.col("field"), "_"), 1)) == name
    numbered = F.col("text").rlike(SCORED_CHAPTER)
    label = F.coalesce(*[F.when((F.col("field") == f) & F.col("label").rlike(p), 1.0) for f, p in extract.NAVIGATION.items()], F.lit(0.0))
    in_rel = F.array_contains(F.split("rel", r"\s+"), F.regexp_replace("field", "_link$", "")).cast("double")
    nav = lambda name: _weighted(name, [("rel", in_rel, 3), ("text", label, 2), ("order", ((F.col("field") == "index_link") | (F.col("anchors") > 1)).cast("double"), 1)])
    field = F.col("field")
    mine = F
    for name, given in (rules or {}).items():
        mine = mine.when(field == name, _weighted(name, given))
    parts = (
        mine.when(field == "title", _weighted("title", [("semantic", (kind != "chapter").cast("double"), 3), ("dom", dom_score(1.0, 0.7, 0.5), 2), ("length", _length_score(size, 2, 80), 1)]))
        .when(field == "author", _weighted("author", [("semantic", text.author_of(F.col("text")).isNotNull().cast("double"), 4), ("length", F.when(text.author_of(F.col("text")).isNotNull(), _length_score(size, 2, 64)), 1)]))
        .when(field == "chapter_title", _weighted("chapter_title", [("semantic", numbered.cast("double"), 4), ("dom", F.when(numbered, dom_score(1.0, 0.5, 0.6)), 2), ("length", F.when(numbered, _length_score(size, 2, 100)), 1)]))
        .when(field == "chapter_list", _weighted("chapter_list", [("count", F.col("count") / TARGET_LINKS, 2), ("continuity", F.col("continuity"), 3), ("same_origin", F.col("same_origin"), 1), ("selector_precision", F.col("precision"), 4)]))
        .when(field == "content", _weighted("content", [("length", F.when(fits, clean / TARGET_CHARS), 2), ("paragraphs", F.when(fits, F.col("paragraphs") / TARGET_PARAGRAPHS), 2), ("link_density", F.when(fits, 1 - 3 * F.col("link_chars") / F.greatest(whole, F.lit(1))), 3), ("cleanliness", F.when(fits, clean / F.greatest(whole, F.lit(1))), 5)]))
        .when(fielded("prev"), nav("prev_link")).when(fielded("next"), nav("next_link")).when(fielded("index"), nav("index_link"))
        .otherwise(_weighted("clean_selector", [("noise_marker", F.lit(1.0), 1)]))
    )
    scored = joined.withColumn("components", parts).withColumn("score", weighted_score(F.col("components")))
    order = Window.partitionBy("page_id", "field").orderBy(F.col("score").desc(), "selector", "node_id")
    return scored.withColumn("rank", F.row_number().over(order)).select("page_id", "kind", "field", "node_id", "selector", "raw_score", "components", "score", "rank")


def decide_fields(kinds: DataFrame, scored: DataFrame) -> DataFrame:
    """page_id, kind, field, selector, score, status, reason of every required
    field: reject under MEDIUM or without a candidate; confirm where the
    runner-up is nearer than MARGIN or the score is under HIGH; else accept."""
    wanted = F.when(F.col("kind") == "book_index", F.array(*map(F.lit, REQUIRED["book_index"]))).when(F.col("kind") == "chapter", F.array(*map(F.lit, REQUIRED["chapter"])))
    needed = kinds.select("page_id", "kind", F.explode(wanted).alias("field"))
    runner = Window.partitionBy("page_id", "field").orderBy("rank")
    best = scored.select("page_id", "field", "selector", "score", "rank").withColumn("_second", F.lead("score").over(runner)).filter("rank = 1").drop("rank")
    joined = needed.join(best, ["page_id", "field"], "left")
    s, close = F.col("score"), F.coalesce(F.round(F.col("score") - F.col("_second"), 12) < MARGIN, F.lit(False))
    status = F.when(s.isNull() | (s < MEDIUM), "reject").when(close | (s < HIGH), "require_confirmation").otherwise("auto_accept")
    reason = F.when(s.isNull(), "missing_field").when(s < MEDIUM, "low_confidence").when(close, "ambiguous_candidates").when(s < HIGH, "low_confidence")
    return joined.select("page_id", "kind", "field", "selector", F.coalesce(s, F.lit(0.0)).alias("score"), status.alias("status"), reason.alias("reason"))


def decide(kinds: DataFrame, fields: DataFrame) -> DataFrame:
    """page_id, decision (the worst of the page's fields), score (their mean)
    and code of pages that are refused by kind."""
    severity = F.max(F.when(F.col("status") == "reject", 2).when(F.col("status") == "require_confirmation", 1).otherwise(0))
    by_page = fields.groupBy("page_id").agg(severity.alias("_s"), F.avg("score").alias("score"))
    code = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in REFUSED.items()], F.when(~F.col("kind").isin(*REQUIRED), "unsupported_page"))
    decision = F.when(F.col("_s") == 0, "auto_accept").when(F.col("_s") == 1, "require_confirmation").otherwise("reject")
    return kinds.select("page_id", "kind").join(by_page, "page_id", "left").select("page_id", "kind", decision.alias("decision"), F.coalesce("score", F.lit(0.0)).alias("score"), code.alias("code"))


def validate_three(sites: DataFrame) -> DataFrame:
    """ok, confidence and reasons of sites: site, catalog_order_ok,
    index_decision, scores (map), and first and second: struct(page_id, next_ok,
    auth_or_error, fingerprint, identity_ok, chars, paragraphs, decision)."""
    a, b = F.col("first"), F.col("second")
    either = lambda name: a[name] | b[name]
    decisions = F.array("index_decision", a["decision"], b["decision"])
    low, high = F.least(a["chars"], b["chars"]), F.greatest(a["chars"], b["chars"])
    shape = (low < 45) | (F.least(a["paragraphs"], b["paragraphs"]) < 1) | (high / F.greatest(low, F.lit(1)) > 8)
    tests = [
        ("catalog_order_invalid", ~F.col("catalog_order_ok")), ("next_link_mismatch", ~a["next_ok"]), ("url_duplicate", a["page_id"] == b["page_id"]), ("auth_or_error", either("auth_or_error")),
        ("content_structure_mismatch", F.coalesce(a["fingerprint"], F.lit("")).isin("") | ~a["fingerprint"].eqNullSafe(b["fingerprint"])), ("book_title_mismatch", ~(a["identity_ok"] & b["identity_ok"])),
        ("content_shape_invalid", shape), ("page_rejected", F.array_contains(decisions, "reject")),
    ]
    reasons = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(True)), name) for name, t in tests]), lambda r: r.isNotNull())
    least = F.coalesce(F.least(F.array_min(F.map_values("scores")), F.lit(1.0)), F.lit(1.0))
    capped = F.when(F.array_contains(decisions, "require_confirmation"), F.least(least, F.lit(0.84))).otherwise(least)
    return sites.withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0).withColumn("confidence", F.when(F.col("ok"), capped).otherwise(0.0)).select("site", "ok", "confidence", "reasons")


def neighbours(catalog: DataFrame, chapters: DataFrame) -> DataFrame:
    """Each chapter (book_id, url) in its catalog (book_id, chapter_index, url):
    the next chapter's url, else the one before; with code where it is absent
    or its catalog has under two distinct links."""
    listed = catalog.withColumn("_url", urls.canonical_url(F.col("url")))
    w = Window.partitionBy("book_id").orderBy("chapter_index")
    placed = listed.withColumn("neighbour", F.coalesce(F.lead("url").over(w), F.lag("url").over(w))).select("book_id", "_url", "chapter_index", "neighbour")
    sizes = listed.groupBy("book_id").agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("_url").alias("_d"))
    found = chapters.select("book_id", "url", urls.canonical_url(F.col("url")).alias("_url")).join(placed, ["book_id", "_url"], "left").join(sizes, "book_id", "left")
    bad = F.coalesce((F.col("_n") < 2) | (F.col("_n") != F.col("_d")), F.lit(True))
    return found.select("book_id", "url", "chapter_index", "neighbour", F.when(bad, "catalog_order_invalid").when(F.col("chapter_index").isNull(), "chapter_not_in_catalog").alias("code"))


def draft_configs(decided: DataFrame) -> DataFrame:
    """(site, field, score, selector) from decided fields with their site: the
    least score of a field, and its selector where all pages agree."""
    one = F.when((F.countDistinct("selector") == 1) & (F.count("selector") == F.count(F.lit(1))), F.min("selector"))
    return decided.groupBy("site", "field").agg(F.min("score").alias("score"), one.alias("selector"))


def shared_selectors(found: DataFrame) -> DataFrame:
    """(site, field, selector): the first selector in order that every page of
    a site offers for a field."""
    pages_of = found.groupBy("site", "field").agg(F.countDistinct("page_id").alias("_all"))
    offered = found.groupBy("site", "field", "selector").agg(F.countDistinct("page_id").alias("_n"))
    return offered.join(pages_of, ["site", "field"]).filter("_n = _all").groupBy("site", "field").agg(F.min("selector").alias("selector"))


def drift(configs: DataFrame, replayed: DataFrame, least: float = HIGH, tolerance: float = 0.0) -> DataFrame:
    """Status of stored configs against a replay: configs (config_id, status,
    fields: map of score, fingerprint), replayed (config_id, transient,
    hard_error, auth, scores: map, fingerprint). A field is low under `least`
    or under its stored score less `tolerance`; absent fields score 0."""
    joined = configs.alias("c").join(replayed.alias("r"), "config_id", "left")
    score_of = lambda k: F.coalesce(F.col("r.scores")[k], F.lit(0.0))
    low = F.array_sort(F.filter(F.map_keys("c.fields"), lambda k: (score_of(k) < least) | (score_of(k) < F.col("c.fields")[k] - tolerance)))
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    cases = [
        (F.col("c.status") == "revoked", "invalid", "config_revoked"), (F.col("c.fingerprint").isNull(), "stale", "fingerprint_baseline_missing"), (F.col("r.scores").isNull() & ~flag("hard_error") & ~flag("auth"), "transient_failure", "acquisition_transient"),
        (flag("transient"), "transient_failure", "acquisition_transient"), (flag("auth"), "stale", "auth_required"), (flag("hard_error"), "invalid", "hard_error"),
        (F.size(low) > 0, "stale", "score_below_threshold"), (~F.col("c.fingerprint").eqNullSafe(F.col("r.fingerprint")), "stale", "fingerprint_mismatch"),
    ]
    status, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for test, s, r in cases:
        status, reason = status.when(test, s), reason.when(test, r)
    return joined.select("config_id", status.otherwise("valid").alias("status"), reason.alias("reason"), low.alias("low_fields"))

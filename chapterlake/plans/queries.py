"""Queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, urls
from ..operators import books, dedup, events, pages, tts
from ..sources import exports, readers
from ..sources.shared import keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _book_rows(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("book_id"))


def _status_chapters(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("chapter_index"), status.alias("status"))


def _line_chapters(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("chapter_index"))


def _documents(spark, d):
    return _t(spark, d, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_index"), F.col("text").alias("body"))


def _turns(spark, d):
    return _t(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("number"), F.col("role").alias("title"), F.col("text").alias("body"))


#: Event types as statuses.
STATUS_OF = {"signup": "created", "view": "probing", "click": "validating", "purchase": "crawling", "error": "recoverable_failed"}


def _events(spark, d):
    names = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _t(spark, d, "events").select(F.col("user_id").alias("task_id"), (F.row_number().over(w) - 1).cast("long").alias("task_version"), F.coalesce(names[F.col("event_type")], F.col("event_type")).alias("to_status"), F.col("ts").alias("created_at"))
    return rows.withColumn("from_status", F.lag("to_status").over(Window.partitionBy("task_id").orderBy("task_version")))


_CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STATUS_OF.items())
_EVENTS = f"""ev AS (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS task_version,
  CASE event_type {_CASES} ELSE event_type END AS to_status, ts AS created_at FROM events),
e AS (SELECT *, lag(to_status) OVER (PARTITION BY task_id ORDER BY task_version) AS from_status FROM ev)"""
_STATUS = "SELECT o_custkey AS book_id, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status FROM orders"
_GRAPH = ", ".join(f"('{a}', '{b}')" for a, many in events.TRANSITIONS.items() for b in many.split())
_WS = r"[\s\x{3000}]"

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query(r"""SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS pages,
  count(DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS paths FROM pages GROUP BY 1""")
def pages_per_host(spark, d):
    p = readers.read_pages(spark, f"{d}/pages.parquet")
    return p.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct(urls.part(F.col("url"), 3)).alias("paths"))


@_query(r"""SELECT page_id, CASE WHEN p = '/' THEN '/' ELSE '/' || array_to_string(list_transform(string_split(p[2:], '/'),
  lambda x, i: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '{int}' WHEN i > 1 AND regexp_full_match(x, '[A-Za-z][A-Za-z0-9._~-]*-[A-Za-z0-9._~-]+') THEN '{slug}' ELSE x END), '/') END AS template
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def path_templates(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.path_template(urls.part(F.col("url"), 3)).alias("template"))


@_query("SELECT page_id, u AS canonical_url, substr(sha256(u), 1, 16) AS key, regexp_extract(u, '^([a-z]+://[^/?#]*)', 1) || '/' AS redacted FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)")
def canonical_urls(spark, d):
    c = urls.canonical_url(F.col("url"))
    return _t(spark, d, "pages").select("page_id", c.alias("canonical_url"), urls.page_id(c).alias("key"), urls.redact_url(F.col("url")).alias("redacted"))


def _decoded(sql: str) -> str:
    """SQL of a text with its character references read as HTML reads them: the
    semicolon may be absent, as where a text was cut."""
    for pattern, said in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#(x27|39);?", "''"), ("&amp;?", "&")):
        sql = f"regexp_replace({sql}, '{pattern}', '{said}', 'g')"
    return sql


_TITLE_TEXT, _HEADING_TEXT = (f"trim({_decoded(f"regexp_extract(html, '<{tag}>([^<]*)</{tag}>', 1)")})" for tag in ("title", "h1"))


@_query(rf"""SELECT page_id, {_TITLE_TEXT} AS title,
  len(regexp_extract_all(html, '<a ')) AS a_count, len(regexp_extract_all(html, '<li>')) AS li_count, len(regexp_extract_all(html, '<article')) AS article_count FROM pages""")
def page_facts(spark, d):
    f = pages.page_facts(pages.flatten(_t(spark, d, "pages")))
    return f.select("page_id", "title", "a_count", "li_count", "article_count")


@_query(r"""SELECT page_id, count(*) AS links, count(DISTINCT href) AS hrefs FROM
  (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""")
def page_links(spark, d):
    p = _t(spark, d, "pages")
    return pages.links(p, pages.flatten(p)).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("href").alias("hrefs"))


_TITLES = "trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&')) AS title, trim(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')) AS heading"
_PLAIN = lambda pattern: pattern.replace("(?iU)", "(?i)")


@_query(f"""WITH t AS (SELECT page_id, html, {_TITLES}, len(list_distinct(list_transform(list_filter(regexp_extract_all(html, '<a href="[^"]*">[^<]*'), lambda a: regexp_matches(a, '>.*{pages.CHAPTER_TEXT}')), lambda a: split_part(a, '"', 2)))) AS links FROM pages),
k AS (SELECT page_id, CASE WHEN regexp_matches(title, '{_PLAIN(pages.ERROR_TITLE)}') THEN 'error.title_marker' WHEN contains(html, '<article') AND regexp_matches(title || ' ' || heading, '{pages.CHAPTER_TEXT}') THEN 'chapter.title_and_content'
  WHEN links >= 3 THEN 'book_index.chapter_link_cluster' WHEN regexp_matches(title, '{_PLAIN(pages.SEARCH_TITLE)}') THEN 'list.search_marker' ELSE '' END AS evidence FROM t)
SELECT page_id, CASE split_part(evidence, '.', 1) WHEN '' THEN 'unknown' WHEN 'list' THEN 'search_or_list' ELSE split_part(evidence, '.', 1) END AS kind,
  (CASE split_part(evidence, '.', 1) WHEN 'error' THEN 0.9 WHEN 'chapter' THEN 0.95 WHEN 'book_index' THEN 0.93 WHEN 'list' THEN 0.88 ELSE 0 END)::DOUBLE AS confidence, evidence FROM k""")
def page_kinds(spark, d):
    p = readers.read_pages(spark, f"{d}/pages.parquet")
    return pages.classify(p, keep(pages.flatten(p))).withColumn("evidence", F.array_join("evidence", ","))


@_query(f"SELECT book_id, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending FROM ({_STATUS}) GROUP BY 1")
def book_progress(spark, d):
    return books.progress(_status_chapters(spark, d))


_LISTED = f"SELECT c_custkey AS book_id, count(id) AS total, count(id) FILTER (status = 'done') AS done, count(id) FILTER (status = 'failed') AS failed, count(id) FILTER (status = 'pending') AS pending FROM customer LEFT JOIN ({_STATUS}) ON c_custkey = book_id GROUP BY 1"


@_query(_LISTED)
def book_list(spark, d):
    return books.list_books(_book_rows(spark, d), _status_chapters(spark, d))


@_query(f"SELECT count(*) AS books, sum(total)::BIGINT AS total, sum(done)::BIGINT AS done, sum(failed)::BIGINT AS failed, sum(pending)::BIGINT AS pending, round(100.0 * sum(done)::DOUBLE / sum(total), 1) AS completion FROM ({_LISTED})")
def global_stats(spark, d):
    return books.global_stats(books.list_books(_book_rows(spark, d), _status_chapters(spark, d)))


@_query(f"SELECT book_id, failed FROM ({_LISTED}) WHERE failed > 0")
def retry_targets(spark, d):
    return books.retry_targets(books.list_books(_book_rows(spark, d), _status_chapters(spark, d)))


@_query(f"SELECT status, count(*) AS n FROM (SELECT CASE status WHEN 'failed' THEN 'pending' ELSE status END AS status FROM ({_STATUS})) GROUP BY 1")
def reset_failed(spark, d):
    return books.reset_failed(_status_chapters(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT book_id, id, status FROM ({_STATUS}) WHERE status <> 'done'")
def pending_chapters(spark, d):
    return books.pending(_status_chapters(spark, d)).select("book_id", "id", "status")


@_query("SELECT user_id AS book_id, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10")
def recent_logs(spark, d):
    return books.recent(_t(spark, d, "events").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("id")), 10).select("book_id", "id")


@_query("""WITH s AS (SELECT user_id AS book_id, unnest(generate_series(min(event_id % 500), max(event_id % 500))) AS chapter_index FROM events GROUP BY 1)
SELECT book_id, chapter_index FROM s ANTI JOIN (SELECT user_id, event_id % 500 AS n FROM events) ON book_id = user_id AND chapter_index = n""")
def missing_indexes(spark, d):
    rows = _t(spark, d, "events").select(F.col("user_id").alias("book_id"), (F.col("event_id") % 500).alias("chapter_index"))
    return books.missing_indexes(rows)


@_query("SELECT l_orderkey AS book_id, l_linenumber AS chapter_index, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_indexes(spark, d):
    return books.duplicate_indexes(_line_chapters(spark, d))


@_query("""SELECT l_orderkey AS book_id, min(l_linenumber) AS "start", max(l_linenumber) AS "end", count(*) AS n,
  count(*) = max(l_linenumber) - min(l_linenumber) + 1 AND count(*) = count(DISTINCT l_linenumber) AS contiguous FROM lineitem GROUP BY 1""")
def contiguity(spark, d):
    return books.contiguity(_line_chapters(spark, d))


@_query(f"SELECT book_id, coalesce(min(id) FILTER (status <> 'done'), max(id) + 1) AS next_index, bool_or(status = 'failed') AS recoverable FROM ({_STATUS}) GROUP BY 1")
def resume_points(spark, d):
    return books.resume_points(_status_chapters(spark, d))


@_query("""SELECT source AS book_id, first_index, doc_id AS chapter_index FROM
  (SELECT source, doc_id, min(doc_id) OVER (PARTITION BY source, md5(text)) AS first_index FROM documents WHERE text IS NOT NULL) WHERE doc_id > first_index""")
def exact_duplicates(spark, d):
    return dedup.exact_duplicates(_documents(spark, d))


_SIMILAR = """WITH u AS (SELECT source AS book_id, text, min(doc_id) AS i FROM documents WHERE length(text) > 0 GROUP BY 1, 2),
g AS (SELECT book_id, i, CASE WHEN length(text) < 2 THEN [text] ELSE list_distinct(list_transform(generate_series(1, length(text) - 1), lambda k: text[k:k + 1])) END AS g FROM u),
p AS (SELECT a.book_id, a.i AS a, b.i AS b, len(list_intersect(a.g, b.g)) AS n, len(a.g) + len(b.g) AS m FROM g a JOIN g b ON a.book_id = b.book_id AND a.i < b.i AND len(a.g) >= 0.85 * len(b.g) AND len(b.g) >= 0.85 * len(a.g))
SELECT book_id, a, b, round(n / (m - n), 6) AS score FROM p WHERE n / (m - n) >= 0.85"""


@_query(_SIMILAR)
def approximate_pairs(spark, d):
    return dedup.approximate_pairs(_documents(spark, d)).withColumn("score", F.round("score", 6))


@_query(_SIMILAR)
def similar_pairs(spark, d):
    return dedup.similar_pairs(_documents(spark, d)).withColumn("score", F.round("score", 6))


_VALIDATE = """WITH c AS (SELECT source AS book_id, doc_id, text AS body FROM documents), b AS (SELECT DISTINCT book_id FROM c),
x AS (SELECT book_id, max(doc_id) - min(doc_id) + 1 - count(DISTINCT doc_id) AS missing, count(*) FILTER (length(coalesce(body, '')) = 0) AS empty, count(*) FILTER (length(body) BETWEEN 1 AND 99) AS short FROM c GROUP BY 1)
SELECT book_id, 'warning' AS level, 'MISSING_INDEX' AS code, missing AS n FROM x WHERE missing > 0
UNION ALL SELECT book_id, 'error', 'EMPTY_CONTENT', empty FROM x WHERE empty > 0
UNION ALL SELECT book_id, 'warning', 'SHORT_CONTENT', short FROM x WHERE short > 0"""


@_query(_VALIDATE)
def validate_books(spark, d):
    c = _documents(spark, d).withColumns({"status": F.lit("done"), "url": F.col("chapter_index").cast("string"), "title": F.concat(F.lit("t"), F.col("chapter_index"))})
    return books.validate(c.select("book_id").distinct(), c)


@_query("SELECT conv_id AS book_id, string_agg(trim(role) || chr(10) || chr(10) || trim(text) || repeat(chr(10), 3), '' ORDER BY turn) AS content FROM conversations GROUP BY 1")
def export_text(spark, d):
    return exports.to_text(_turns(spark, d).withColumnRenamed("number", "chapter_index"))


@_query(r"""SELECT conv_id AS book_id, string_agg('## ' || role || chr(10) || chr(10) || array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: x || chr(10) || chr(10)), ''), '' ORDER BY turn) AS content FROM conversations GROUP BY 1""")
def export_markdown(spark, d):
    return exports.to_markdown(_turns(spark, d).withColumnRenamed("number", "chapter_index"))


@_query("SELECT conv_id AS book_id, turn AS number, length(text) / 10.0 AS duration, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 10.0 AS \"offset\" FROM conversations")
def subtitle_offsets(spark, d):
    rows = _turns(spark, d).select("book_id", "number", F.length("body").cast("double").alias("duration"))
    return tts.timeline(rows).select("book_id", "number", (F.col("duration") / 10).alias("duration"), (F.col("offset") / 10).alias("offset"))


@_query("SELECT book_id, chapter_id, chapter_number, status FROM (SELECT conv_id AS book_id, turn::VARCHAR AS chapter_id, turn AS chapter_number, CASE WHEN length(text) >= 5 THEN 'QUEUED' ELSE 'SKIPPED' END AS status FROM conversations)")
def tts_jobs(spark, d):
    rows = _turns(spark, d).select("book_id", F.lit(None).cast("string").alias("chapter_id"), F.col("number").alias("chapter_number"), F.col("title").alias("chapter_title"), F.col("body").alias("content"))
    return tts.ingest(rows).select("book_id", "chapter_id", "chapter_number", "status")


@_query(f"""WITH {_EVENTS}, g(f, t) AS (VALUES {_GRAPH}),
v AS (SELECT e.*, CASE WHEN from_status IN ('completed', 'terminal_failed', 'cancelled') THEN 'terminal_exit' WHEN from_status IS NULL THEN CASE WHEN to_status <> 'created' THEN 'first_status' END ELSE 'illegal_transition' END AS code
  FROM e LEFT JOIN g ON from_status = f AND to_status = t WHERE f IS NULL)
SELECT task_id, task_version, from_status, to_status, code FROM v WHERE code IS NOT NULL""")
def audit_transitions(spark, d):
    return events.audit_transitions(_events(spark, d))


@_query(f"WITH {_EVENTS} SELECT task_id, count(*) AS events, bool_and(task_version = rn AND prev IS NOT DISTINCT FROM from_status) AS intact FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY task_version) - 1 AS rn, lag(to_status) OVER (PARTITION BY task_id ORDER BY task_version) AS prev FROM e) GROUP BY 1")
def chain_integrity(spark, d):
    return events.chain_integrity(_events(spark, d))


@_query(f"WITH {_EVENTS} SELECT task_id, max(task_version) AS version, arg_max(to_status, task_version) AS status, arg_max(to_status, task_version) IN ('completed', 'terminal_failed', 'cancelled') AS terminal FROM e GROUP BY 1")
def current_state(spark, d):
    return events.current_state(_events(spark, d))


@_query(f"WITH {_EVENTS} SELECT task_id, arg_max(struct_pack(f := from_status), task_version).f AS resume_status FROM e GROUP BY 1 HAVING arg_max(to_status, task_version) IN ('paused', 'recoverable_failed')")
def resume_status(spark, d):
    return events.resume_status(_events(spark, d))


@_query("SELECT user_id AS host, event_id AS id, g AS gap_us FROM (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) WHERE g < 3600000000")
def politeness(spark, d):
    return events.politeness(_t(spark, d, "events").select(F.col("user_id").alias("host"), "ts", F.col("event_id").alias("id")), 3600).select("host", "id", "gap_us")


@_query(f"WITH {_EVENTS} SELECT date_trunc('hour', created_at) AS \"start\", to_status, count(*) AS n FROM e GROUP BY 1, 2")
def event_rates(spark, d):
    return events.rates(_events(spark, d))


@_query("""SELECT doc_id, length(text) AS n, CASE WHEN length(text) <= 16 THEN '1-16' WHEN length(text) <= 64 THEN '17-64' ELSE '65+' END AS bucket,
  CASE WHEN length(text) > 200 THEN text[1:200] || chr(10) || chr(10) || '...' ELSE text END AS preview, md5(text) AS md5, sha256(text) AS sha256 FROM documents""")
def text_summaries(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n"), text.length_bucket(F.length(t)).alias("bucket"), text.preview(t, 200).alias("preview"), F.md5(t.cast("binary")).alias("md5"), F.sha2(t, 256).alias("sha256"))


@_query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^{_WS}+', ''), '{_WS}+$', '')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+', ''), '{_WS}+$', '') AS text FROM documents""")
def normalized_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.normalize_blank_lines(F.col("text")).alias("text"))


@_query("SELECT lang AS kind, count(*) AS cases, avg(quality) AS rate, avg(quality) >= 0.9 AS passed FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1")
def success_gate(spark, d):
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id").filter("quality is not null")
    return rows.groupBy(F.col("lang").alias("kind")).agg(F.count(F.lit(1)).alias("cases"), F.avg("quality").alias("rate")).withColumn("passed", F.col("rate") >= 0.9)

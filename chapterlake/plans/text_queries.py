"""Queries on texts, chapters, configs and exports, over columns that Spark
derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import adapt, books, configs, tts
from ..sources import exports
from .queries import _documents, _query, _status_chapters, _t, _turns

_LABEL = text.CREDENTIAL
_HITS = rf"""(regexp_matches(text, '(?im)^\s*authorization\s*:\s*(?:bearer\s+)?\S+') OR regexp_matches(text, '(?i)(?:^|[^a-z0-9]){_LABEL}\s*=\s*\S+')
  OR regexp_matches(text, '(?i)["'']{_LABEL}["'']\s*:\s*["''][^"'']+["'']') OR regexp_matches(text, '(?im)^\s*cookie\s*:\s*[^\s=;]+=[^\s;]+') OR regexp_matches(text, '(?i)<\s*(?:html|body)(?:\s|>)')
  OR regexp_matches(text, '(?i)profile(?:_|\s+)path\s*[:=]\s*\S+') OR regexp_matches(text, '(?i)(?:^|[^a-z0-9_]){_LABEL}\s*:\s*=?\s*[^\s,;]+')
  OR len(list_filter(regexp_extract_all(text, '(?i)(?:^|\s)bearer\s+([a-z0-9._~+/=-]+)(?:$|[\s,;])', 1), lambda v: length(v) >= 6 AND (length(v) >= 16 OR regexp_matches(v, '[0-9._~+/=-]')))) > 0)"""
_UNSAFE = r"""(regexp_matches(text, '(?i)https?://|(?:^|[^A-Za-z0-9_])[A-Za-z]:[\\/][^\s]+|(?:^|[^A-Za-z0-9_])\\\\[^\\\s]+\\[^\s]+|(?:^|[^A-Za-z0-9_])/(?:[^/\s]+/)*[^/\s]+|(?:password|passwd|token|secret|cookie|authorization|profile[_ -]?path)\s*[:=]')
  OR regexp_matches(text, '[\x00-\x1f]'))"""


@_query(f"SELECT doc_id, {_HITS} AS sensitive FROM documents")
def sensitive_texts(spark, d):
    return _t(spark, d, "documents").select("doc_id", (F.size(text.sensitive_hits(F.col("text"))) > 0).alias("sensitive"))


@_query(f"SELECT doc_id, CASE WHEN text IS NULL OR {_UNSAFE} THEN '[redacted]' ELSE text[1:256] END AS shown FROM documents")
def redacted_texts(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("shown"))


@_query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT contains(x, 'http') AND NOT contains(x, '@') AND trim(x) <> ''), chr(10)) AS text FROM documents")
def kept_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.drop_lines(F.col("text"), ("http", "@"), ("",)).alias("text"))


@_query("SELECT conv_id, turn, turn + 1 AS \"index\", (turn * 2.5)::DOUBLE AS \"start\", (turn * 2.5 + 2.0)::DOUBLE AS \"end\", length(trim(replace(text, chr(10), ' '))) AS chars FROM conversations WHERE trim(text) <> ''")
def subtitle_blocks(spark, d):
    start = F.col("turn") * 2.5
    line = F.concat(F.format_string("%d\n", F.col("turn") + 1), text.srt_timestamp(start), F.lit(" --> "), text.srt_timestamp(start + 2.0), F.lit("\n"), F.trim(F.replace("text", F.lit("\n"), F.lit(" "))), F.lit("\n\n"))
    rows = _t(spark, d, "conversations").filter("trim(text) <> ''").select("conv_id", "turn", F.explode(text.srt_blocks(line)).alias("b"))
    return rows.select("conv_id", "turn", F.col("b.index").cast("long").alias("index"), F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.length("b.text").cast("long").alias("chars"))


@_query("""SELECT o_custkey AS book_id, o_orderkey AS chapter_index, '第' || (o_orderkey % 7) || '章 x' AS "before", '第' || o_orderkey || '章 x' AS "after" FROM orders WHERE o_orderkey % 7 <> o_orderkey""")
def title_repairs(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("chapter_index"), F.concat(F.lit("第"), (F.col("o_orderkey") % 7).cast("string"), F.lit("章 x")).alias("title"))
    return books.title_repairs(rows)


_KNOWN = "SELECT o_orderkey AS id, o_custkey AS book_id, o_orderkey AS chapter_index, 'u' || o_orderkey AS canonical_url, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'pending' END AS status FROM orders"
_NEW = "SELECT o_orderkey AS position, o_custkey AS book_id, CASE o_orderkey % 4 WHEN 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS chapter_index, CASE o_orderkey % 3 WHEN 0 THEN 'n' || o_orderkey ELSE 'u' || o_orderkey END AS canonical_url FROM orders"


@_query(f"""WITH k AS ({_KNOWN}), n AS ({_NEW}) SELECT position, CASE WHEN i.id IS NULL AND u.id IS NULL THEN 'insert' WHEN i.id IS NOT NULL AND coalesce(u.id = i.id, true) AND i.status <> 'done' THEN 'update' ELSE 'ignore' END AS action
FROM n LEFT JOIN k i ON i.book_id = n.book_id AND i.chapter_index = n.chapter_index LEFT JOIN k u ON u.book_id = n.book_id AND u.canonical_url = n.canonical_url""")
def chapter_upserts(spark, d):
    key = F.col("o_orderkey")
    named = lambda p: F.concat(F.lit(p), key.cast("string"))
    known = _status_chapters(spark, d).withColumn("canonical_url", F.concat(F.lit("u"), F.col("id").cast("string")))
    incoming = _t(spark, d, "orders").select(
        key.alias("position"), F.col("o_custkey").alias("book_id"), F.when(key % 4 == 0, -key - 1).otherwise(key).alias("chapter_index"), F.lit("t").alias("title"), F.when(key % 3 == 0, named("n")).otherwise(named("u")).alias("canonical_url")
    )
    return books.upsert_chapters(known, incoming).select("position", "action")


@_query("""WITH d AS (SELECT *, doc_id % 3 = 0 AS known FROM documents),
h AS (SELECT DISTINCT source, sha256(text) AS h FROM d WHERE known AND text IS NOT NULL),
n AS (SELECT doc_id, source, text, sha256(text) AS h, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS k FROM d WHERE NOT known)
SELECT doc_id AS id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'chapter_content_empty' WHEN h.h IS NOT NULL OR k > 1 THEN 'chapter_content_duplicate' ELSE 'accepted' END AS outcome FROM n LEFT JOIN h USING (source, h)""")
def content_accepts(spark, d):
    rows = _documents(spark, d).withColumnRenamed("chapter_index", "id").withColumn("known", F.col("id") % 3 == 0)
    chapters = rows.select("id", "book_id", F.when(F.col("known"), "done").otherwise("pending").alias("status"), F.when(F.col("known"), F.sha2("body", 256)).alias("content_hash"))
    return books.accept_content(chapters, rows.filter("not known").select("id", "book_id", "body")).select("id", "outcome")


@_query("SELECT 'books' AS \"table\", count(*) AS n FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'chapters', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def delete_plan(spark, d):
    shelf = _t(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), "c_nationkey")
    return books.delete_plan(shelf, _status_chapters(spark, d), shelf.filter("c_nationkey = 3"))


_BOOK = "SELECT o_custkey AS book_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS pending FROM orders GROUP BY 1"


@_query(f"""WITH b AS ({_BOOK}), l AS (SELECT user_id, string_agg(event_id, ',' ORDER BY event_id DESC) AS logs FROM (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10) GROUP BY 1),
g AS (SELECT o_custkey AS book_id FROM orders GROUP BY 1 HAVING max(o_orderkey) - min(o_orderkey) + 1 > count(*)),
e AS (SELECT o_custkey AS book_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS book_id, coalesce(total, 0) AS total, array_to_string(list_filter([CASE WHEN e.book_id IS NOT NULL THEN 'EMPTY_CONTENT' END, CASE WHEN failed > 0 THEN 'FAILED_CHAPTERS' END, CASE WHEN g.book_id IS NOT NULL THEN 'MISSING_INDEX' END,
  CASE WHEN total IS NULL THEN 'NO_CHAPTERS' END, CASE WHEN pending > 0 THEN 'PENDING_CHAPTERS' END], lambda x: x IS NOT NULL), ',') AS issues, coalesce(logs, '') AS logs
FROM customer LEFT JOIN b ON b.book_id = c_custkey LEFT JOIN l ON user_id = c_custkey LEFT JOIN g ON g.book_id = c_custkey LEFT JOIN e ON e.book_id = c_custkey""")
def book_reports(spark, d):
    shelf = _t(spark, d, "customer").select(F.col("c_custkey").alias("book_id"))
    chapters = _status_chapters(spark, d).withColumns({"url": F.col("id").cast("string"), "title": F.col("id").cast("string"), "body": F.lit(None).cast("string")})
    logs = _t(spark, d, "events").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("id"))
    out = books.report(shelf, chapters, logs)
    return out.select("book_id", "total", F.array_join(F.array_sort("issues.code"), ",").alias("issues"), F.array_join(F.col("logs").cast("array<string>"), ",").alias("logs"))


@_query("SELECT event_id AS page_id FROM events WHERE length(props) > 0 AND ts >= TIMESTAMP '2024-01-13 00:00:00'")
def fresh_pages(spark, d):
    rows = _t(spark, d, "events").select(F.col("event_id").alias("page_id"), F.col("props").alias("html"), F.col("ts").cast("timestamp").alias("retrieved_at"))
    return books.fresh_pages(rows, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("page_id")


@_query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)
SELECT page_id, CASE WHEN min(page_id) OVER (PARTITION BY host) % 2 = 0 THEN 'int' ELSE 'any' END || ':' || host AS config_id FROM h QUALIFY min(page_id) OVER (PARTITION BY host) % 2 = 1 OR regexp_full_match(p, '/[^/]+/[0-9]+')""")
def active_configs(spark, d):
    p = _t(spark, d, "pages").select("page_id", "url", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("host"))
    even = F.min("page_id") % 2 == 0
    stored = p.groupBy(F.col("host").alias("domain")).agg(even.alias("even")).select(
        "domain", F.concat(F.when(F.col("even"), "int:").otherwise("any:"), "domain").alias("config_id"), F.lit(1).alias("version"), F.lit("active").alias("status"), F.lit("2024").alias("validated"),
        F.when(F.col("even"), F.array(F.lit("/*/{int}"))).otherwise(F.array(F.lit("/**"), F.lit("/x"))).alias("url_patterns"),
    )
    return configs.active_for(p, stored)


@_query("""SELECT l_orderkey AS book_id, l_linenumber AS n, coalesce(lead(l_linenumber) OVER w, lag(l_linenumber) OVER w) AS neighbour FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def catalog_neighbours(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("chapter_index")).distinct()
    link = F.concat(F.lit("http://shelf.test/"), F.col("book_id").cast("string"), F.lit("/"), F.col("chapter_index").cast("string"))
    catalog = rows.withColumn("url", link)
    found = adapt.neighbours(catalog, catalog.select("book_id", "url"))
    return found.select("book_id", F.col("chapter_index").alias("n"), F.substring_index("neighbour", "/", -1).try_cast("long").alias("neighbour"))


@_query("SELECT user_id AS site, event_type AS field, min(value) AS score, CASE WHEN count(DISTINCT props) = 1 THEN min(props) END AS selector FROM events GROUP BY 1, 2")
def draft_configs(spark, d):
    return adapt.draft_configs(_t(spark, d, "events").select(F.col("user_id").alias("site"), F.col("event_type").alias("field"), F.col("value").alias("score"), F.col("props").alias("selector")))


@_query("""SELECT conv_id AS book_id, to_json(struct_pack(book := struct_pack(id := 'book-' || conv_id), chapters := list(struct_pack(number := turn, id := 'book-' || conv_id || '-chapter-' || turn, title := role, content := trim(text)) ORDER BY turn)))::VARCHAR AS document
FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def exchange_documents(spark, d):
    rows = _turns(spark, d).withColumnRenamed("number", "chapter_index").withColumn("status", F.lit("done"))
    return exports.to_exchange(rows.select("book_id").distinct(), rows).filter("document is not null").select("book_id", "document")


@_query("SELECT o_custkey AS book_id, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'COMPLETED' ELSE 'INCOMPLETE' END AS status, count(*) AS jobs FROM orders GROUP BY 1")
def job_manifests(spark, d):
    jobs = _t(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("chapter_number"), F.col("o_orderkey").cast("string").alias("chapter_id"), F.lit("t").alias("chapter_title"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("QUEUED").alias("status"))
    return tts.manifests(jobs).select("book_id", "status", F.json_array_length(F.get_json_object("manifest", "$.chapters")).cast("long").alias("jobs"))


_FILES = """SELECT l_orderkey AS o, max(l_linenumber = 1) AS mp3, max(l_linenumber = 2) AS srt, max(l_linenumber = 3) AS m4b, count(*) FILTER (l_linenumber > 3) AS n FROM lineitem GROUP BY 1"""


@_query(f"SELECT o AS \"output\", CASE WHEN mp3 AND srt AND m4b THEN 'completed' WHEN (mp3 AND srt) OR n > 0 THEN 'running' ELSE 'empty' END AS status, CASE WHEN mp3 AND srt AND m4b THEN 'completed' WHEN mp3 AND srt THEN 'm4b_pending' WHEN mp3 AND n > 0 THEN 'assembling' WHEN n > 0 THEN 'chapters' ELSE 'pending' END AS phase FROM ({_FILES})")
def group_progress(spark, d):
    n = F.col("l_linenumber")
    made = F.when(n == 1, "g.mp3").when(n == 2, "g.srt").when(n == 3, "g.m4b").otherwise(F.concat(n.cast("string"), F.lit(".mp3")))
    files = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("output"), F.lit("g").alias("group"), F.when(n <= 3, "assembled").otherwise("chapters").alias("folder"), made.alias("name"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("modified"))
    none = files.limit(0).select("output", "group", F.lit("").alias("status"), F.lit(False).alias("assembled"))
    return tts.group_progress(files, none, "2024-01-01 00:00:00").select("output", "status", "phase")

"""Queries on book administration, exports, configs, task tables and streams,
over columns that Spark derives from the given tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, urls
from ..operators import adapt, books, configs, dedup, events, tts
from ..sources import exports, readers, shared
from ..sources.shared import keep
from ..streaming import tasks
from .queries import _EVENTS, _GRAPH, _STATUS, _WS, _documents, _events, _query, _status_chapters, _t, _turns


def _stripped(sql: str) -> str:
    return f"regexp_replace(regexp_replace({sql}, '^{_WS}+', ''), '{_WS}+$', '')"


_NL = "chr(10)"
_LINES = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_stripped('x')}), lambda x: x <> '')"


@_query("SELECT doc_id AS page_id, CASE WHEN doc_id % 2 = 1 AND text IS NOT NULL THEN 'utf-16-be' ELSE 'utf-8' END AS encoding, md5(text) AS md5 FROM documents")
def decoded_pages(spark, d):
    odd = F.col("doc_id") % 2 == 1
    body = F.when(odd, F.encode("text", "UTF-16BE")).otherwise(F.encode("text", "UTF-8"))
    kind = F.when(odd, "text/html; charset=UTF-16-BE").otherwise("text/html")
    raw = _t(spark, d, "documents").select(F.col("doc_id").alias("page_id"), body.alias("body"), kind.alias("content_type"))
    return readers.decode_pages(raw).select("page_id", "encoding", F.md5(F.col("html").cast("binary")).alias("md5"))


#: Sentences in three scripts, and the encodings that bodies of them come in.
_SIMPLIFIED = "他站在山门前，望着远处的群山，心中忽然明白了师父当年说过的那些话。夜色渐渐深了，风从谷底吹上来，带着松树的气味。"
_TRADITIONAL = "她把書放回架上，轉身對老人說：這個故事我從小聽到大，卻從來沒有想過結局會是這樣。窗外下著雨，街上的燈一盞一盞亮起來。"
_JAPANESE = "彼は静かに本を閉じて、窓の外を見つめた。雨はまだ降り続いていて、町の明かりがぼんやりと滲んでいる。明日の朝には、すべてが変わっているだろう。"
_BODIES = [("gb18030", _SIMPLIFIED), ("big5", _TRADITIONAL), ("shift-jis", _JAPANESE), ("euc-jp", _JAPANESE), ("utf-16-le", _TRADITIONAL), ("utf-16-be", _SIMPLIFIED), ("utf-8", _JAPANESE)]


@_query("SELECT page_id, CASE page_id % 7 " + " ".join(f"WHEN {k} THEN '{name}'" for k, (name, _) in enumerate(_BODIES)) + " END AS encoding, md5('<p>' || page_id || repeat(CASE page_id % 7 " + " ".join(f"WHEN {k} THEN '{said}'" for k, (_, said) in enumerate(_BODIES)) + " END, 2 + page_id % 3)) AS md5 FROM (SELECT doc_id AS page_id FROM documents)")
def guessed_pages(spark, d):
    """Bodies without a declared charset in seven encodings, one a document."""
    k = (F.col("doc_id") % 7).cast("int")
    of = lambda at: F.element_at(F.array(*[F.lit(x[at]) for x in _BODIES]), k + 1)
    html = F.concat(F.lit("<p>"), F.col("doc_id").cast("string"), F.repeat(of(1), (2 + F.col("doc_id") % 3).cast("int")))
    made = _t(spark, d, "documents").select(F.col("doc_id").alias("page_id"), of(0).alias("name"), html.alias("html"))

    def encode(batches):
        for batch in batches:
            bodies = [t.encode(n) for n, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary()), pa.nulls(len(bodies), pa.string())], ["page_id", "body", "content_type"])

    raw = made.mapInArrow(encode, "page_id long, body binary, content_type string")
    return readers.decode_pages(raw).select("page_id", "encoding", F.md5(F.col("html").cast("binary")).alias("md5"))


def _url_list(spark, d):
    key = F.col("page_id").cast("string")
    lines = F.array(F.concat(F.lit("  "), "url", F.lit(" ")), F.concat(F.lit("# page "), key), F.lit(""), F.concat(F.lit("ftp://h.test/"), key), F.concat(F.lit("http://user@h.test/"), key))
    path = shared.new_folder(spark)
    _t(spark, d, "pages").select(F.explode(lines)).write.text(path)
    return readers.read_url_list(spark, path)


_URLS = "(SELECT trim(url) AS url, true AS valid FROM pages UNION ALL SELECT 'ftp://h.test/' || page_id, false FROM pages UNION ALL SELECT 'http://user@h.test/' || page_id, false FROM pages)"


@_query(f"SELECT url, valid FROM {_URLS}")
def listed_urls(spark, d):
    return _url_list(spark, d)


@_query(f"SELECT count(*) AS requested, count(*) FILTER (valid) AS created, count(*) FILTER (NOT valid) AS failed FROM {_URLS}")
def listed_url_counts(spark, d):
    return readers.url_summary(_url_list(spark, d))


@_query(r"""SELECT 'cfg_' || host AS config_id, host AS domain, n::INT AS version, '/**' AS pattern, 'h1' AS title FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY 1)""")
def stored_configs(spark, d):
    """One JSON file a host, written and read back."""
    hosts = _t(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    book = F.struct(F.create_map(F.lit("title"), F.lit("h1")).alias("book"))
    rows = hosts.select("host", F.to_json(F.struct(F.concat(F.lit("cfg_"), "host").alias("config_id"), F.col("host").alias("domain"), F.col("n").alias("version"), F.array(F.lit("/**")).alias("url_patterns"), book.alias("selectors"))).alias("value"))
    path = shared.new_folder(spark)
    rows.withColumnRenamed("host", "of").write.partitionBy("of").text(path)
    return readers.read_configs(spark, path).select("config_id", "domain", "version", F.get("url_patterns", F.lit(0)).alias("pattern"), F.col("selectors.book")["title"].alias("title"))


_JSON_BOOK = "to_json(struct_pack(\"type\" := 'book', book_id := conv_id))::VARCHAR"
_JSON_TURN = "to_json(struct_pack(\"type\" := 'chapter', \"index\" := turn, title := role, content := coalesce(text, '')))::VARCHAR"


@_query(f"SELECT DISTINCT conv_id AS book_id, -1 AS nth, {_JSON_BOOK} AS line FROM conversations UNION ALL SELECT conv_id, turn, {_JSON_TURN} FROM conversations")
def json_lines(spark, d):
    rows = _turns(spark, d).withColumnRenamed("number", "chapter_index").withColumn("body", F.coalesce("body", F.lit("")))
    return exports.to_json_lines(rows.select("book_id").distinct(), rows)


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@_query(f"""SELECT conv_id AS book_id, format('chap_{{:05d}}.xhtml', turn) AS file, '<h1>' || {_ESC.format('role')} || '</h1>' || chr(10) || array_to_string(list_transform({_LINES}, lambda x: '<p>' || {_ESC.format('x')} || '</p>'), chr(10)) AS content FROM conversations""")
def chapter_xhtml(spark, d):
    rows = _turns(spark, d).withColumnRenamed("number", "chapter_index").withColumn("body", F.coalesce("body", F.lit("")))
    return exports.to_xhtml(rows)


_TEXT = "string_agg(trim(role) || chr(10) || chr(10) || trim(text) || repeat(chr(10), 3), '' ORDER BY turn)"
_MARKDOWN = f"string_agg('## ' || role || chr(10) || chr(10) || array_to_string(list_transform({_LINES}, lambda x: x || chr(10) || chr(10)), ''), '' ORDER BY turn)"


@_query(f"""SELECT book_id, format, md5(content) AS md5 FROM (SELECT conv_id AS book_id, 'unheard-of' AS format, {_TEXT} AS content FROM c GROUP BY 1 UNION ALL SELECT conv_id, 'md', {_MARKDOWN} FROM c GROUP BY 1
  UNION ALL SELECT conv_id, 'jsonl', {_JSON_BOOK} || chr(10) || string_agg({_JSON_TURN}, chr(10) ORDER BY turn) FROM c GROUP BY 1)""".replace("FROM c", "FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"))
def export_formats(spark, d):
    """Every book in each format; one that nobody registered is text."""
    rows = _turns(spark, d).withColumnRenamed("number", "chapter_index").withColumn("body", F.coalesce("body", F.lit("")))
    out = None
    for name in ("md", "jsonl", "unheard-of"):
        made = exports.exporter(name)(rows).select("book_id", F.lit(name).alias("format"), F.md5(F.col("content").cast("binary")).alias("md5"))
        out = made if out is None else out.unionByName(made)
    return out


@_query("""WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT count(*) AS books, count(o_custkey) AS exported, count(*) - count(o_custkey) AS failed, 0::BIGINT AS remaining FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def export_all(spark, d):
    shelf = _t(spark, d, "customer").select(F.col("c_custkey").alias("book_id"))
    rows = _status_chapters(spark, d).withColumns({"title": F.col("id").cast("string"), "body": F.lit("x")})
    return exports.export_all(shelf, rows, "txt")


@_query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS s, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h FROM pages),
p AS (SELECT *, lag(s) OVER (ORDER BY page_id) AS s0, lag(h) OVER (ORDER BY page_id) AS h0 FROM u) SELECT page_id, s = s0 AND h = h0 AS same, true AS own FROM p""")
def page_origins(spark, d):
    """Whether a page shares the origin of the page before it, and its own with
    the default port written out."""
    p = _t(spark, d, "pages").select("page_id", "url")
    before = p.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("before"))
    host_port = F.regexp_replace("url", "^(http)://([^/?#]*)", "$1://$2:80")
    return p.join(before, "page_id", "left").select("page_id", urls.same_origin(F.col("url"), F.col("before")).alias("same"), urls.same_origin(F.col("url"), F.regexp_replace(host_port, "^(https)://([^/?#]*)", "$1://$2:443")).alias("own"))


@_query("SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'chapter_redirect_mismatch' END AS code FROM pages")
def final_urls(spark, d):
    """A fragment more is the same page; a segment more is not."""
    p, k = _t(spark, d, "pages"), F.col("page_id") % 3
    moved = F.regexp_replace("url", "^([a-z]+://[^/?#]*)", "$1/moved")
    final = F.when(k == 0, F.concat("url", F.lit("#part"))).when(k == 1, moved).otherwise(F.col("url"))
    return p.select("page_id", urls.final_url_error(F.col("url"), final).alias("code"))


@_query(f"""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN coalesce(text, '') ELSE role || chr(10) || chr(10) || coalesce(text, '') END AS raw FROM conversations), s AS (SELECT *, position(chr(10) || chr(10) IN raw) AS gap FROM r)
SELECT conv_id, turn, {_stripped("CASE WHEN gap > 0 THEN raw[1:gap - 1] ELSE raw END")} AS title, CASE WHEN gap > 0 THEN {_stripped("raw[gap + 2:]")} ELSE '' END AS body FROM s""")
def chapter_parts(spark, d):
    body = F.coalesce("text", F.lit(""))
    raw = F.when(F.col("turn") % 3 == 0, body).otherwise(text.format_chapter(F.col("role"), body))
    rows = _t(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return rows.select("conv_id", "turn", text.chapter_title(F.col("raw")).alias("title"), text.chapter_body(F.col("raw")).alias("body"))


@_query(r"""WITH n AS (SELECT doc_id, '. ' || text || '?' AS name FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, regexp_replace(regexp_replace(name, '[\\/:*?"<>|\r\n\t]+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g') AS file, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '^[\s\x{3000}]+', ''), '[\s\x{3000}]+$', ''), '[/\\?%*:|"<>\r\n\s\x{3000}#]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS name FROM n)
SELECT doc_id, coalesce(nullif(file[1:120], ''), 'untitled') AS file, coalesce(nullif(name, ''), 'untitled')[1:80] AS name FROM f""")
def safe_names(spark, d):
    name = F.concat(F.lit(". "), "text", F.lit("?"))
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", text.safe_filename(name).alias("file"), text.safe_name(name).alias("name"))


_FIRST, _SECOND = {"a": "е", "e": "а", "1": "一"}, {"е": "i", "一": "二"}


@_query("SELECT doc_id, md5(translate(translate(text, 'ae1', 'еа一'), 'е一', 'i二')) AS md5 FROM documents")
def decoded_texts(spark, d):
    """Two character maps, one after the other."""
    out = text.decode_map(text.decode_map(F.col("text"), _FIRST), _SECOND)
    return _t(spark, d, "documents").select("doc_id", F.md5(out.cast("binary")).alias("md5"))


@_query(f"""SELECT book_id, '[' || repeat('#', floor(done / total * 30)::INT) || repeat('-', 30 - floor(done / total * 30)::INT) || '] ' || floor(done / total * 100)::INT || '% (' || done || '/' || total || ')' AS bar
FROM (SELECT book_id, count(*) AS total, count(*) FILTER (status = 'done') AS done FROM ({_STATUS}) GROUP BY 1)""")
def progress_bars(spark, d):
    return books.progress(_status_chapters(spark, d)).select("book_id", text.progress_bar(F.col("done"), F.col("total")).alias("bar"))


@_query(r"SELECT doc_id, doc_id % 5 = 0 AND text IS NOT NULL OR coalesce(regexp_matches(text, '[\x{AC00}-\x{D7A3}]'), false) AS hangul FROM documents")
def hangul_texts(spark, d):
    shown = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" 한"))).otherwise(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.coalesce(text.has_hangul(shown), F.lit(False)).alias("hangul"))


_CODES = {"view": "parse_failed", "error": "connection_timeout", "click": "duplicate_content", "signup": "Parse_Failed"}


@_query("SELECT event_id, CASE event_type WHEN 'view' THEN 'parse_failed' WHEN 'error' THEN 'connection_timeout' WHEN 'click' THEN 'duplicate_content' ELSE 'chapter_download_failed' END AS code FROM events")
def error_codes(spark, d):
    said = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])[F.col("event_type")]
    return _t(spark, d, "events").select("event_id", text.safe_error_code(said).alias("code"))


@_query(f"SELECT conv_id, turn, CASE WHEN {_stripped('''coalesce(text, '')''')} = '' THEN 'chapter_content_empty' WHEN turn % 3 <> turn AND turn % 4 <> 1 THEN 'chapter_title_mismatch' END AS code FROM conversations")
def chapter_checks(spark, d):
    """Titles numbered by turn % 3; a stored title of its own lets one pass."""
    turn = F.col("turn")
    stored = F.when(turn % 4 == 0, "").when(turn % 4 == 1, "A name").when(turn % 4 == 2, F.concat(F.lit("第"), turn.cast("string"), F.lit("章")))
    title = F.concat(F.lit("第"), (turn % 3).cast("string"), F.lit("章 x"))
    return _t(spark, d, "conversations").select("conv_id", "turn", text.chapter_error(turn, stored, title, F.col("text")).alias("code"))


@_query("""SELECT o_orderkey, least(greatest(o_orderkey * 1000000 - 5000000000, 0), 2147483647) AS n,
CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') || '+08:00' END AS stamp FROM orders""")
def public_rows(spark, d):
    key, at = F.col("o_orderkey"), lambda form: F.date_format("o_orderdate", form)
    stamp = (
        F.when(key % 4 == 0, F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(key % 4 == 1, F.concat(at("yyyy-MM-dd HH:mm"), F.lit("+08:00")))
        .when(key % 4 == 2, at("yyyy-MM-dd HH:mm:ss")).otherwise("2024-13-01T00:00:00Z")
    )
    return _t(spark, d, "orders").select("o_orderkey", text.safe_count(key * 1_000_000 - 5_000_000_000).alias("n"), text.safe_timestamp(stamp).alias("stamp"))


_KNOWN_REASONS = """[CASE WHEN k % 11 = 0 THEN 'catalog_order_invalid' END, CASE WHEN k % 6 = 0 THEN 'next_link_mismatch' END, CASE WHEN k % 8 = 0 THEN 'url_duplicate' END, CASE WHEN k % 7 = 0 THEN 'auth_or_error' END, CASE WHEN k % 5 = 0 THEN 'content_structure_mismatch' END,
  CASE WHEN k % 10 = 0 THEN 'book_title_mismatch' END, CASE WHEN least(50 + k % 100, 40 + k % 500) < 45 OR k % 3 = 0 OR greatest(50 + k % 100, 40 + k % 500) > 8 * least(50 + k % 100, 40 + k % 500) THEN 'content_shape_invalid' END, CASE WHEN k % 9 = 0 THEN 'page_rejected' END]"""


@_query(f"""WITH s AS (SELECT c_custkey AS k FROM customer), r AS (SELECT k, list_filter({_KNOWN_REASONS}, lambda x: x IS NOT NULL) AS reasons FROM s)
SELECT k AS site, len(reasons) = 0 AS ok, CASE WHEN len(reasons) > 0 THEN 0.0 WHEN k % 4 = 0 THEN least((k % 10) / 10, 0.84) ELSE (k % 10) / 10 END::DOUBLE AS confidence, array_to_string(reasons, ',') AS reasons FROM r""")
def three_page_checks(spark, d):
    k = F.col("c_custkey")
    page = lambda key, ok, auth, mark, own, chars, paragraphs, decision: F.struct(key.alias("page_id"), ok.alias("next_ok"), auth.alias("auth_or_error"), mark.alias("fingerprint"), own.alias("identity_ok"), chars.alias("chars"), paragraphs.alias("paragraphs"), decision.alias("decision"))
    first = page(k, k % 6 != 0, k % 7 == 0, F.lit("f"), k % 10 != 0, 50 + k % 100, 1 + k % 2, F.when(k % 9 == 0, "reject").otherwise("auto_accept"))
    second = page(F.when(k % 8 == 0, k).otherwise(-k - 1), F.lit(True), F.lit(False), F.when(k % 5 == 0, "g").otherwise("f"), F.lit(True), 40 + k % 500, k % 3, F.lit("auto_accept"))
    sites = _t(spark, d, "customer").select(
        k.alias("site"), (k % 11 != 0).alias("catalog_order_ok"), F.when(k % 4 == 0, "require_confirmation").otherwise("auto_accept").alias("index_decision"), F.create_map(F.lit("content"), (k % 10) / 10).alias("scores"), first.alias("first"), second.alias("second")
    )
    return adapt.validate_three(sites).withColumn("reasons", F.array_join("reasons", ","))


@_query("""SELECT k AS config_id, CASE WHEN k % 9 = 0 THEN 'invalid' WHEN k % 8 = 0 THEN 'stale' WHEN k % 10 = 0 OR k % 11 = 0 THEN 'transient_failure' WHEN k % 7 = 0 THEN 'stale' WHEN k % 13 = 0 THEN 'invalid' WHEN k % 4 = 0 OR k % 5 = 0 THEN 'stale' ELSE 'valid' END AS status,
  CASE WHEN k % 9 = 0 THEN 'config_revoked' WHEN k % 8 = 0 THEN 'fingerprint_baseline_missing' WHEN k % 10 = 0 OR k % 11 = 0 THEN 'acquisition_transient' WHEN k % 7 = 0 THEN 'auth_required' WHEN k % 13 = 0 THEN 'hard_error' WHEN k % 4 = 0 THEN 'score_below_threshold' WHEN k % 5 = 0 THEN 'fingerprint_mismatch' END AS reason,
  CASE WHEN k % 10 = 0 THEN 'content,title' WHEN k % 4 = 0 THEN 'content' ELSE '' END AS low_fields FROM (SELECT c_custkey AS k FROM customer)""")
def config_drift(spark, d):
    k = F.col("config_id")
    keys = _t(spark, d, "customer").select(F.col("c_custkey").alias("config_id"))
    field = lambda content, title: F.create_map(F.lit("content"), content, F.lit("title"), title)
    stored = keys.select("config_id", F.when(k % 9 == 0, "revoked").otherwise("active").alias("status"), field(F.lit(0.9), F.lit(0.86)).alias("fields"), F.when(k % 8 != 0, F.lit("f")).alias("fingerprint"))
    scores = field(F.when(k % 4 == 0, 0.5).otherwise(0.95), F.lit(0.9))
    replayed = keys.filter(k % 10 != 0).select("config_id", (k % 11 == 0).alias("transient"), (k % 13 == 0).alias("hard_error"), (k % 7 == 0).alias("auth"), scores.alias("scores"), F.when(k % 5 == 0, "g").otherwise("f").alias("fingerprint"))
    return adapt.drift(stored, replayed).withColumn("low_fields", F.array_join("low_fields", ","))


def _configs(spark, d):
    """Configs of customers, each rule broken by some."""
    k = F.col("c_custkey")
    number = k.cast("string")
    policy = F.struct((k % 150).cast("double").alias("timeout_seconds"), (k % 12).cast("int").alias("max_retries"), (k % 80).cast("double").alias("rate_limit_seconds"))
    book = F.create_map(F.lit("title"), F.lit("h1"), F.lit("chapter_list"), F.when(k % 4 == 0, "").otherwise(".list a"))
    chapter = F.create_map(F.lit("content"), F.when(k % 6 == 0, "").otherwise("#content"), F.lit("paragraph"), F.lit("p"))
    return _t(spark, d, "customer").select(
        k, F.when(k % 2 == 0, F.concat(F.lit("cfg_"), F.lpad(number, 16, "0"))).otherwise("bad").alias("config_id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("site"), number)).alias("site"),
        F.when(k % 7 == 0, "bad_domain").otherwise(F.concat(F.lit("d"), number, F.lit(".example.com"))).alias("domain"),
        F.when(k % 3 == 0, F.array(F.lit("/book/{int}"))).when(k % 3 == 1, F.array(F.lit("/x?y"))).otherwise(F.array(F.lit("https://other.test/**"))).alias("url_patterns"),
        F.struct(F.when(k % 11 == 0, F.array(F.lit("a:has(b)"))).otherwise(F.array(F.lit(".ad"))).alias("clean"), book.alias("book"), chapter.alias("chapter")).alias("selectors"),
        policy.alias("request_policy"), F.create_map(F.lit("title"), (k % 10) / 10 + F.when(k % 13 == 0, 1.0).otherwise(0.0)).alias("field_scores"),
    )


@_query("""SELECT k, concat_ws(',', CASE WHEN k % 5 = 0 THEN 'site' END, CASE WHEN k % 6 = 0 THEN 'chapter.content' END) AS errors, CASE WHEN k % 4 = 0 THEN 'book.chapter_list' ELSE '' END AS warnings, k % 5 <> 0 AND k % 6 <> 0 AS valid FROM (SELECT c_custkey AS k FROM customer)""")
def config_checks(spark, d):
    return configs.check(_configs(spark, d)).select(F.col("c_custkey").alias("k"), F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "valid")


@_query("""SELECT k, concat_ws(',', CASE WHEN k % 2 = 1 THEN 'config_id' END, CASE WHEN k % 7 = 0 THEN 'domain' END, CASE WHEN k % 3 <> 0 THEN 'url_patterns' END, CASE WHEN k % 4 = 0 OR k % 6 = 0 OR k % 11 = 0 THEN 'selectors' END,
  CASE WHEN k % 150 = 0 OR k % 150 > 120 THEN 'timeout_seconds' END, CASE WHEN k % 12 > 10 THEN 'max_retries' END, CASE WHEN k % 80 > 60 THEN 'rate_limit_seconds' END, CASE WHEN k % 13 = 0 AND k % 10 > 0 THEN 'field_scores' END) AS errors FROM (SELECT c_custkey AS k FROM customer)""")
def strict_configs(spark, d):
    return configs.strict_errors(_configs(spark, d)).select(F.col("c_custkey").alias("k"), F.array_join("errors", ",").alias("errors"))


@_query("""WITH i AS (SELECT 'u' || CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS url, arg_max(o_orderpriority, o_orderkey) AS title FROM orders GROUP BY 1)
SELECT coalesce(k.url, i.url) AS url, k.c_custkey AS book_id, coalesce(i.title, k.c_name) AS title FROM (SELECT *, 'u' || c_custkey AS url FROM customer) k FULL JOIN i ON k.url = i.url""")
def book_upserts(spark, d):
    known = _t(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_name").alias("title"))
    key = F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))
    incoming = _t(spark, d, "orders").select(F.concat(F.lit("u"), key.cast("string")).alias("url"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("position"))
    return books.upsert_books(known, incoming)


@_query(f"SELECT id, first_value(id) OVER w AS kept_id, id = first_value(id) OVER w AS winner FROM (SELECT *, id % 5 AS k FROM ({_STATUS})) WINDOW w AS (PARTITION BY book_id, k ORDER BY (status <> 'done')::INT, id)")
def identity_merges(spark, d):
    rows = _status_chapters(spark, d).withColumn("key", F.col("id") % 5)
    return books.merge_identities(rows, "key").select("id", "kept_id", "winner")


@_query("""WITH f AS (SELECT l_orderkey AS id, min(CASE WHEN l_linenumber % 2 = 0 THEN 'parse_failed' ELSE 'what?' END) AS e FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
c AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, o_orderkey % 3 AS attempt_count, CASE WHEN o_orderkey % 4 = 0 THEN 'w' END AS claim_owner FROM orders)
SELECT c.id, CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit THEN CASE WHEN e = 'parse_failed' THEN e ELSE 'chapter_download_failed' END END AS error, CASE WHEN hit AND claim_owner IS NULL THEN attempt_count + 1 ELSE attempt_count END AS attempt_count
FROM (SELECT c.*, e, e IS NOT NULL AND status <> 'done' AS hit FROM c LEFT JOIN f ON c.id = f.id) c""")
def failure_marks(spark, d):
    chapters = _status_chapters(spark, d).select("id", "status", F.lit(None).cast("string").alias("error"), (F.col("id") % 3).alias("attempt_count"), F.when(F.col("id") % 4 == 0, F.lit("w")).alias("claim_owner"))
    failures = _t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "parse_failed").otherwise("what?").alias("error"))
    return books.mark_failed(chapters, failures).drop("claim_owner")


@_query("SELECT c_custkey AS book_id, safe, n FROM (SELECT *, count(*) OVER (PARTITION BY safe) AS n FROM (SELECT c_custkey, c_mktsegment || '_' || c_nationkey AS safe FROM customer)) WHERE n > 1")
def title_collisions(spark, d):
    """Titles that differ only in characters that a file name cannot hold."""
    sep = F.when(F.col("book_id") % 2 == 0, ":").otherwise("?")
    shelf = _t(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), "c_mktsegment", "c_nationkey")
    return books.title_collisions(shelf, text.safe_filename(F.concat("c_mktsegment", sep, F.col("c_nationkey").cast("string")))).select("book_id", "safe", "n")


@_query("""SELECT book_id, chapter_index, CASE WHEN dup THEN 'failed' ELSE 'done' END AS status, CASE WHEN dup THEN 'duplicate_content' END AS error FROM
(SELECT source AS book_id, doc_id AS chapter_index, text IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY source, md5(text)) AS dup FROM documents)""")
def removed_duplicates(spark, d):
    rows = _documents(spark, d)
    return books.remove_duplicates(rows.select("book_id", "chapter_index", F.lit("done").alias("status")), dedup.exact_duplicates(rows))


@_query("SELECT o_custkey AS book_id, count(*) AS jobs, count(*) FILTER (o_orderstatus <> 'P') AS finished, CASE WHEN bool_and(o_orderstatus <> 'P') THEN 'COMPLETED' ELSE 'INCOMPLETE' END AS status FROM orders GROUP BY 1")
def job_status(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "SKIPPED").otherwise("QUEUED")
    return tts.book_status(_t(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), status.alias("status")))


@_query("SELECT event_id, CASE WHEN event_id % 8 < 6 THEN 'RETRY_WAIT' ELSE 'FAILED' END AS status, CASE WHEN event_id % 8 < 6 THEN least(2.0 ** (event_id % 8), 30.0) END::DOUBLE AS backoff FROM events")
def retry_plan(spark, d):
    return tts.retry(_t(spark, d, "events").select("event_id", (F.col("event_id") % 8).alias("attempt")), 6).select("event_id", "status", "backoff")


@_query("SELECT o_orderkey AS task_id FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-01-01 00:00:00')")
def orphaned_tasks(spark, d):
    waiting = _t(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "P", "waiting_for_user").otherwise("crawling").alias("status"))
    leases = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_shipdate").cast("timestamp").alias("expires_at"))
    return events.orphaned_waiting(waiting, leases, F.lit("1997-01-01 00:00:00").cast("timestamp")).select("task_id")


@_query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND (o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 OR o_totalprice <= 150000.0)")
def claimable_chapters(spark, d):
    owner = F.when(F.col("o_orderkey") % 3 == 1, "me").when(F.col("o_orderkey") % 3 == 2, "other")
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"), owner.alias("claim_owner"), F.col("o_totalprice").alias("claim_until"))
    return events.claimable(rows, "me", 150_000.0).select("id")


@_query("SELECT user_id AS task_id, event_id % 50 AS task_version, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def version_conflicts(spark, d):
    return events.version_conflicts(_t(spark, d, "events").select(F.col("user_id").alias("task_id"), (F.col("event_id") % 50).alias("task_version")))


@_query(f"""WITH {_EVENTS}, g(f, t) AS (VALUES {_GRAPH}),
x AS (SELECT task_id, max(task_version) AS last, min(task_version) FILTER (CASE WHEN from_status IS NULL THEN to_status <> 'created' ELSE t IS NULL END) AS bad FROM e LEFT JOIN g ON from_status = f AND to_status = t GROUP BY 1)
SELECT x.task_id, coalesce(e.task_version, -1) AS version, e.to_status AS status, CASE WHEN e.to_status IN ('paused', 'recoverable_failed') THEN e.from_status END AS resume_status,
  CASE WHEN bad = last THEN 'illegal_transition' WHEN bad < last THEN 'version_conflict' END AS code FROM x LEFT JOIN e ON x.task_id = e.task_id AND e.task_version = coalesce(bad - 1, last)""")
def live_tasks(spark, d):
    """Task states of a stream of events. A refused event leaves the version, so
    all later ones of its task are conflicts."""
    stream = shared.stream_of(_events(spark, d).select("task_id", "task_version", "to_status", F.col("created_at").cast("timestamp").alias("created_at")))
    return tasks.last_states(spark, tasks.run_states(tasks.task_states(stream, late="1 day")))


@_query(r"""WITH p AS (SELECT regexp_replace(url, '#.*$', '') AS canonical_url, min(page_id) AS page_id, min_by(html, page_id) AS html FROM pages GROUP BY 1)
SELECT min(page_id) AS page_id, sha256(coalesce(html, '')) AS content_hash FROM p GROUP BY html""")
def taken_pages(spark, d):
    """Page intake over a stream that gives every page twice, once with a
    fragment: one row for each canonical URL and content."""
    p = _t(spark, d, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("retrieved_at"))
    again = p.withColumns({"url": F.concat("url", F.lit("#again")), "page_id": F.col("page_id") + (1 << 40)})
    target, stream = shared.new_folder(spark), shared.stream_of(p.unionByName(again))
    tasks.intake(stream, target, shared.new_folder(spark)).awaitTermination()
    return spark.read.parquet(target).select((F.col("page_id") % (1 << 40)).alias("page_id"), "content_hash")


@_query("""SELECT o_orderkey AS task_id, CASE WHEN gone THEN 3 ELSE 2 END AS version, CASE WHEN gone THEN 'recoverable_failed' ELSE 'waiting_for_user' END AS status, CASE WHEN gone THEN 'waiting_for_user' END AS resume_status, CASE WHEN gone THEN 'wait_expired' END AS code
FROM (SELECT o_orderkey, epoch_ms(o_orderdate) + 1800000 < (SELECT max(epoch_ms(o_orderdate)) FROM orders) - 86400000 AS gone FROM orders)""")
def expired_waits(spark, d):
    """Every order a task that waits since its date: those fail whose wait has
    passed by the newest date less a day."""
    key, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    moves = F.posexplode(F.array(*[F.lit(s) for s in ("created", "probing", "waiting_for_user")])).alias("task_version", "to_status")
    rows = _t(spark, d, "orders").select(key.alias("task_id"), at.alias("created_at"), moves).withColumn("task_version", F.col("task_version").cast("long"))
    return tasks.last_states(spark, tasks.run_states(tasks.task_states(shared.stream_of(rows), "30 minutes", "1 day")))


_CLAIMS = """c AS (SELECT l_orderkey AS book_id, 'w' || l_suppkey % 3 AS owner, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_extendedprice) AS generation, 't' || l_linenumber AS token,
  l_shipdate AS since, l_shipdate + INTERVAL 20 DAY AS expires, l_linenumber AS n FROM lineitem),
w AS (SELECT book_id, generation AS write_id, since + to_days((n * 9 % 31)::INTEGER) AS done, CASE WHEN n % 5 <> 0 THEN CASE n % 5 WHEN 1 THEN 'other' ELSE owner END END AS owner, CASE WHEN n % 5 <> 0 THEN generation END AS generation,
  CASE WHEN n % 5 <> 0 THEN CASE n % 5 WHEN 2 THEN 'x' ELSE token END END AS token FROM c)"""


@_query(f"""WITH {_CLAIMS}, m AS (SELECT w.book_id, w.write_id, w.done, w.owner, w.generation, w.token, c.owner AS o, c.generation AS g, c.token AS t, c.expires AS e,
  row_number() OVER (PARTITION BY w.book_id, w.write_id ORDER BY c.since DESC, c.generation DESC) AS k FROM w LEFT JOIN c ON c.book_id = w.book_id AND c.since <= w.done)
SELECT book_id, write_id, CASE WHEN generation IS NULL THEN CASE WHEN e > done THEN 'unclaimed_write' END WHEN g IS NULL THEN 'no_claim' WHEN g <> generation THEN 'stale_generation' WHEN o <> owner THEN 'wrong_owner'
  WHEN t <> token THEN 'wrong_token' WHEN e <= done THEN 'expired_claim' END AS code FROM m WHERE k = 1""")
def fenced_writes(spark, d):
    """Every line of an order a claim of one chapter, and a write some days on,
    by its own claim, a wrong owner or token, or by none."""
    n, w = F.col("l_linenumber"), Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice")
    at = F.col("l_shipdate").cast("timestamp")
    days = lambda k: F.make_dt_interval(k)
    named = lambda value: F.when(n % 5 != 0, value)
    owner, token = F.concat(F.lit("w"), (F.col("l_suppkey") % 3).cast("string")), F.concat(F.lit("t"), n.cast("string"))
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.lit(1).alias("chapter_index"), n.alias("n"), owner.alias("owner"), F.row_number().over(w).cast("long").alias("generation"), token.alias("token"), at.alias("at"))
    claims = lines.withColumn("expires_at", F.col("at") + days(F.lit(20)))
    n = F.col("n")
    writes = lines.select(
        "book_id", "chapter_index", F.col("generation").alias("write_id"), (F.col("at") + days((n * 9 % 31).cast("int"))).alias("at"), named(F.when(n % 5 == 1, "other").otherwise(F.col("owner"))).alias("owner"),
        named(F.col("generation")).alias("generation"), named(F.when(n % 5 == 2, "x").otherwise(F.col("token"))).alias("token"),
    )
    return events.fenced(claims, writes).select("book_id", "write_id", "code")


_VISITS = """r AS (SELECT user_id AS host, ts, event_id AS id FROM events), m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS middle FROM events),
s AS (SELECT host, ts, id, CASE WHEN ts >= middle THEN 900 ELSE 60 + host % 7 * 600 END AS least, CASE WHEN ts >= middle THEN 14400 ELSE 3600 * (1 + host % 5) END AS pause FROM r, m),
g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, max(epoch_us(ts) + pause * 1000000) OVER (PARTITION BY host ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, lag(epoch_us(ts)) OVER w AS before FROM s WINDOW w AS (PARTITION BY host ORDER BY ts, id))"""


def _requests(spark, d):
    """Requests of a host an event, and two settings of each host: from the
    beginning, and from the middle of the time on."""
    rows = _t(spark, d, "events").select(F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    us = F.unix_micros("ts")
    span = rows.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))  # one row
    hosts = rows.select("host").distinct().crossJoin(F.broadcast(span))
    first = hosts.select("host", F.timestamp_micros("lo").alias("since"), (60 + F.col("host") % 7 * 600).cast("double").alias("min_seconds"), (3600 * (1 + F.col("host") % 5)).cast("double").alias("pause_seconds"))
    later = hosts.select("host", F.timestamp_micros((F.col("lo") + (F.col("hi") - F.col("lo")) / 2).cast("long")).alias("since"), F.lit(900.0).alias("min_seconds"), F.lit(14400.0).alias("pause_seconds"))
    return rows, keep(first.unionByName(later))


@_query(f"WITH {_VISITS} SELECT host, count(*) AS requests, count(*) FILTER (reach IS NULL OR epoch_us(ts) > reach) AS visits, count(*) FILTER (gap < least * 1000000) AS impolite, coalesce(max(gap) FILTER (epoch_us(ts) > reach), 0)::BIGINT AS longest_pause_us FROM g GROUP BY 1")
def host_visits(spark, d):
    """Visits, requests that came too soon and the longest pause of each host."""
    requests, intervals = _requests(spark, d)
    visited = keep(events.visits(requests, intervals))
    soon = events.impolite(requests, intervals).groupBy("host").agg(F.count(F.lit(1)).alias("impolite"))
    longest = events.pauses(visited).groupBy("host").agg(F.max("pause_us").alias("longest_pause_us"))
    out = visited.groupBy("host").agg(F.sum("requests").alias("requests"), F.count(F.lit(1)).alias("visits")).join(soon, "host", "left").join(longest, "host", "left")
    return out.select("host", "requests", "visits", F.coalesce("impolite", F.lit(0)).alias("impolite"), F.coalesce("longest_pause_us", F.lit(0)).alias("longest_pause_us"))


@_query(f"WITH {_VISITS} SELECT host, ts, id, gap AS gap_us, 'too_soon' AS code FROM g WHERE gap < least * 1000000 UNION ALL SELECT host, ts, id, gap, 'long_pause' FROM g WHERE epoch_us(ts) > reach")
def streamed_gaps(spark, d):
    """Requests that came too soon or after a long pause, from a stream that is
    stopped after each of three batches; every second request comes half an hour
    late, some of them a batch after requests that follow them."""
    requests, intervals = _requests(spark, d)
    came = F.unix_micros("ts") + F.col("id") % 2 * 1_800_000_000
    ends = requests.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))  # one row
    third = F.least(F.lit(2), F.floor(3 * (came - F.col("lo")) / (F.col("hi") - F.col("lo") + 1)))
    dealt = keep(requests.crossJoin(F.broadcast(ends)).withColumn("n", third.cast("int")))
    # a request after all others, so that the watermark passes them
    closing = ends.select(F.lit(-1).alias("host"), F.timestamp_micros(F.col("hi") + 86_400_000_000).alias("ts"), F.lit(-1).alias("id"), F.lit(2).alias("n"))
    path, target, checkpoint = (shared.new_folder(spark) for _ in range(3))
    for n in range(3):
        batch = dealt.select("host", "ts", "id", "n").unionByName(closing).filter(F.col("n") == n).drop("n")
        batch.write.mode("append").parquet(path)
        tasks.run_gaps(tasks.request_gaps(spark.readStream.schema(batch.schema).parquet(path), intervals), target, checkpoint)
    return spark.read.parquet(target).select("host", "ts", "id", "gap_us", "code")


@_query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS book_id, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 1000 ORDER BY o_custkey || ':' || o_orderkey) = 1 AS lead, o_orderkey % 2 = 0 AS even FROM orders)
SELECT book_id, k AS chapter_index, 'http://shelf.test/' || CASE WHEN NOT lead AND even AND k % 3 = 0 THEN 'n' ELSE 'u' END || k AS canonical_url, CASE WHEN lead OR even THEN 'done' ELSE 'pending' END AS status,
  CASE WHEN lead THEN sha256('b' || k % 1000) WHEN even THEN sha256('c' || k) END AS content_hash, CASE WHEN even THEN 'chapter_content_conflict' WHEN NOT lead THEN 'chapter_content_duplicate' END AS error FROM o""")
def streamed_chapters(spark, d):
    """Every order a chapter of its customer's book, in a stream that is stopped
    after each of three batches: bodies that repeat within a book; new urls of
    every third chapter and new bodies of every second; the first batch again."""
    k = F.col("o_orderkey")
    orders = _t(spark, d, "orders").select(k, F.col("o_custkey").cast("long").alias("book_id"), k.cast("long").alias("chapter_index"), F.lit("t").alias("title"), k.cast("long").alias("position"))
    named = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    columns = ["book_id", "chapter_index", "title", "url", "body", "position"]
    first = orders.withColumns({"url": named("http://shelf.test/u", k), "body": named("b", k % 1000)}).select(*columns)
    third = k % 3 == 0
    second = orders.filter(third | (k % 2 == 0)).withColumns({"url": F.when(third, named("http://shelf.test/n", k)).otherwise(named("http://shelf.test/u", k)), "body": F.when(k % 2 == 0, named("c", k))}).select(*columns)
    path, store, checkpoint = (shared.new_folder(spark) for _ in range(3))
    for batch in (first, second, first):
        batch.write.mode("append").parquet(path)
        tasks.chapter_intake(spark.readStream.schema(batch.schema).parquet(path), store, checkpoint, buckets=8).awaitTermination()
    return tasks.ChapterStore(spark, store, 8).read().select("book_id", "chapter_index", "canonical_url", "status", "content_hash", "error")

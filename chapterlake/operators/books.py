"""Operators on books and chapters.

chapters: book_id, chapter_index, title, url, status, body; books: book_id.
Null statuses count as no status; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

STATUSES = ("done", "failed", "pending")


def _counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]


def progress(chapters: DataFrame) -> DataFrame:
    """Chapters of each book by status, and in all."""
    return chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("total"), *_counts())


def list_books(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Every book with its counts; books without chapters have zeros."""
    names = ("total", *STATUSES)
    return books.join(progress(chapters), "book_id", "left").fillna(0, list(names))


def global_stats(listed: DataFrame) -> DataFrame:
    return listed.agg(
        F.count(F.lit(1)).alias("books"),
        *[F.sum(s).alias(s) for s in ("total", *STATUSES)],
        F.round(100.0 * F.sum("done") / F.sum("total"), 1).alias("completion"),
    )


def retry_targets(listed: DataFrame) -> DataFrame:
    return listed.filter("failed > 0").select("book_id", "failed")


def reset_failed(chapters: DataFrame) -> DataFrame:
    return chapters.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))


def pending(chapters: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    out = chapters.filter(F.col("status") != "done")
    if start is not None:
        out = out.filter(F.col("chapter_index") >= start)
    return out if end is None else out.filter(F.col("chapter_index") <= end)


def recent(logs: DataFrame, n: int = 50) -> DataFrame:
    """The newest n log rows of each book."""
    newest = Window.partitionBy("book_id").orderBy(F.col("id").desc())
    return logs.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= n)


def upsert_books(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """By url: known ids stay, the last incoming fields (by position) win."""
    last = Window.partitionBy("url").orderBy(F.col("position").desc())
    new = incoming.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "position")
    k, i = known.alias("k"), new.alias("i")
    fields = [c for c in known.columns if c not in ("url", "book_id")]
    return k.join(i, "url", "full").select("url", "k.book_id", *[F.coalesce(f"i.{c}", f"k.{c}").alias(c) for c in fields])


def merge_identities(chapters: DataFrame, key: str) -> DataFrame:
    """One chapter for each (book, key): done first, then least id. Returns the
    rows with kept_id and winner (the rest are the audit)."""
    order = Window.partitionBy("book_id", key).orderBy((F.col("status") != "done").cast("int"), "id")
    return chapters.withColumn("kept_id", F.first("id").over(order)).withColumn("winner", F.col("id") == F.col("kept_id"))


def reject_duplicate_content(chapters: DataFrame) -> DataFrame:
    """Done chapters whose body hash an earlier one of the book has."""
    same = Window.partitionBy("book_id", "content_hash").orderBy("chapter_index")
    return chapters.filter(F.col("status") == "done").withColumn("first_index", F.first("chapter_index").over(same)).withColumn("error_code", F.when(F.col("first_index") < F.col("chapter_index"), F.lit("chapter_content_duplicate")))


def missing_indexes(chapters: DataFrame) -> DataFrame:
    """Indexes between a book's least and largest that no chapter has."""
    span = chapters.groupBy("book_id").agg(F.min("chapter_index").alias("lo"), F.max("chapter_index").alias("hi"))
    wanted = span.select("book_id", F.explode(F.sequence("lo", "hi")).alias("chapter_index"))
    return wanted.join(chapters.select("book_id", "chapter_index"), ["book_id", "chapter_index"], "left_anti")


def duplicate_indexes(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("book_id", "chapter_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def contiguity(chapters: DataFrame) -> DataFrame:
    """Start, end, count and whether the indexes have no gap."""
    out = chapters.groupBy("book_id").agg(F.min("chapter_index").alias("start"), F.max("chapter_index").alias("end"), F.count(F.lit(1)).alias("n"), F.countDistinct("chapter_index").alias("d"))
    return out.select("book_id", "start", "end", "n", ((F.col("n") == F.col("end") - F.col("start") + 1) & (F.col("n") == F.col("d"))).alias("contiguous"))


def resume_points(chapters: DataFrame) -> DataFrame:
    """The first index not done, else the one after the last."""
    todo = F.min(F.when(F.col("status") != "done", F.col("chapter_index")))
    return chapters.groupBy("book_id").agg(F.coalesce(todo, F.max("chapter_index") + 1).alias("next_index"), F.max(F.col("status") == "failed").alias("recoverable"))


def validate(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Issues of every book: book_id, level, code, n."""
    done = F.col("status") == "done"
    short = lambda lo, hi: F.count_if(done & F.length(F.coalesce("body", F.lit(""))).between(lo, hi))
    stats = chapters.groupBy("book_id").agg(
        *_counts(),
        short(0, 0).alias("empty"),
        short(1, 99).alias("short"),
        F.count_if(done & F.coalesce(F.col("body").rlike("[\\x{AC00}-\\x{D7A3}]"), F.lit(False))).alias("hangul"),
        F.count(F.nullif(F.trim("title"), F.lit(""))).alias("titles"),
        (F.max("chapter_index") - F.min("chapter_index") + 1 - F.countDistinct("chapter_index")).alias("missing"),
    )
    repeated = lambda c, rows: rows.groupBy("book_id", c).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").groupBy("book_id").agg(F.count(F.lit(1)).alias(f"dup_{c}"))
    titled = chapters.withColumn("title", F.nullif(F.trim("title"), F.lit(""))).filter(F.col("title").isNotNull())
    joined = books.select("book_id").join(stats, "book_id", "left")
    for c, rows in (("chapter_index", chapters), ("url", chapters), ("title", titled)):
        joined = joined.join(repeated(c, rows), "book_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    many = F.when(F.col("dup_title") > F.greatest(F.lit(3), F.floor(F.col("titles") / 20)), F.col("dup_title"))
    rules = [
        ("error", "NO_CHAPTERS", F.when(F.col("done").isNull(), 1)), ("error", "FAILED_CHAPTERS", F.col("failed")), ("warning", "PENDING_CHAPTERS", F.col("pending")),
        ("error", "DUPLICATE_INDEX", F.col("dup_chapter_index")), ("error", "DUPLICATE_URL", F.col("dup_url")), ("warning", "MANY_DUPLICATE_TITLES", many),
        ("warning", "MISSING_INDEX", F.col("missing")), ("error", "EMPTY_CONTENT", F.col("empty")), ("warning", "SHORT_CONTENT", F.col("short")), ("warning", "RESIDUAL_OBFUSCATION", F.col("hangul")),
    ]
    issues = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), n(c).alias("n")) for level, code, c in rules])
    return joined.select("book_id", F.explode(F.filter(issues, lambda x: x["n"] > 0)).alias("i")).select("book_id", "i.*")


def title_collisions(books: DataFrame, name: Column) -> DataFrame:
    same = Window.partitionBy("safe")
    return books.withColumn("safe", name).withColumn("n", F.count(F.lit(1)).over(same)).filter("n > 1")


def upsert_chapters(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """What becomes of incoming chapters (book_id, chapter_index, title, url,
    canonical_url, position): action insert, update or ignore, and the known id
    (known: id, book_id, chapter_index, canonical_url, status).

    Insert where neither index nor url is known; update the row that has both,
    or the index where the url is free; done rows and urls bound to another
    index stay. Of incoming rows with one index or one url the first counts.
    """
    first = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy("position"))
    new = incoming.withColumn("_i", first("book_id", "chapter_index")).withColumn("_u", first("book_id", "canonical_url"))
    by_index = known.select("book_id", "chapter_index", F.col("id").alias("_by_index"), F.col("status").alias("_status"))
    by_url = known.select("book_id", "canonical_url", F.col("id").alias("_by_url"))
    joined = new.join(by_index, ["book_id", "chapter_index"], "left").join(by_url, ["book_id", "canonical_url"], "left")
    open_ = F.coalesce(F.col("_status") != "done", F.lit(True))
    action = (
        F.when((F.col("_i") > 1) | (F.col("_u") > 1), "ignore").when(F.col("_by_index").isNull() & F.col("_by_url").isNull(), "insert")
        .when(F.col("_by_index").isNotNull() & F.coalesce(F.col("_by_url") == F.col("_by_index"), F.lit(True)) & open_, "update").otherwise("ignore")
    )
    return joined.withColumn("action", action).select(*incoming.columns, "action", F.when(F.col("action") == "update", F.col("_by_index")).alias("id"))


def accept_content(chapters: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome of incoming bodies (id, book_id, body) for known chapters (id,
    book_id, status, content_hash): accepted, unchanged, or an error code. Of
    equal bodies in one batch the lowest id is first."""
    hashed = incoming.withColumn("_h", F.sha2("body", 256))
    mine = chapters.select("id", "status", F.col("content_hash").alias("_old"))
    held = chapters.filter("status = 'done' and content_hash is not null").groupBy("book_id", F.col("content_hash").alias("_h")).agg(F.min("id").alias("_a"), F.max("id").alias("_b"))
    joined = hashed.join(mine, "id", "left").join(held, ["book_id", "_h"], "left").withColumn("_n", F.row_number().over(Window.partitionBy("book_id", "_h").orderBy("id")))
    done, same = F.col("status") == "done", F.col("_old") == F.col("_h")
    other = F.coalesce((F.col("_a") != F.col("id")) | (F.col("_b") != F.col("id")), F.lit(False))
    outcome = (
        F.when(F.coalesce(F.trim("body"), F.lit("")) == "", "chapter_content_empty").when(done & same, "unchanged").when(done, "chapter_content_conflict")
        .when(other | (F.col("_n") > 1), "chapter_content_duplicate").otherwise("accepted")
    )
    return joined.select("id", "book_id", outcome.alias("outcome"))


def mark_failed(chapters: DataFrame, failures: DataFrame) -> DataFrame:
    """Chapters with failures (id, error) applied: a stored code, one attempt
    more unless claimed; done rows stay."""
    known = failures.groupBy("id").agg(F.min("error").alias("_e"), F.lit(True).alias("_f"))
    hit = F.coalesce("_f", F.lit(False)) & (F.coalesce("status", F.lit("")) != "done")
    attempts = F.coalesce("attempt_count", F.lit(0)) + F.when(F.col("claim_owner").isNull(), 1).otherwise(0)
    out = chapters.join(known, "id", "left").withColumn("_hit", hit)
    changed = {"status": F.lit("failed"), "error": text.safe_error_code(F.col("_e")), "attempt_count": attempts}
    return out.select(*[F.when(F.col("_hit"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in chapters.columns])


def delete_books(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the books in `gone` (book_id)."""
    keys = gone.select("book_id").distinct()
    return {name: df.join(keys, "book_id", "left_anti") for name, df in tables.items()}


def deletable_content(chapters: DataFrame, gone: DataFrame) -> DataFrame:
    """Hashes that only books in `gone` refer to."""
    refs = chapters.filter("content_hash is not null").select("book_id", "content_hash").distinct()
    marked = refs.join(gone.select("book_id").distinct().withColumn("_g", F.lit(True)), "book_id", "left")
    return marked.groupBy("content_hash").agg(F.min(F.coalesce("_g", F.lit(False))).alias("only")).filter("only").select("content_hash")


def remove_duplicates(chapters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Chapters with those of `pairs` (book_id, chapter_index) failed as
    duplicate_content."""
    out = chapters.join(pairs.select("book_id", "chapter_index").distinct().withColumn("_d", F.lit(True)), ["book_id", "chapter_index"], "left")
    return out.withColumn("status", F.when(F.col("_d"), "failed").otherwise(F.col("status"))).withColumn("error", F.when(F.col("_d"), F.lit("duplicate_content"))).drop("_d")


def title_repairs(chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_index, before, after) of titles whose number is not
    their chapter's index."""
    fixed = chapters.select("book_id", "chapter_index", F.col("title").alias("before"), text.fix_title(F.col("chapter_index"), F.coalesce("title", F.lit(""))).alias("after"))
    return fixed.filter(~F.col("before").eqNullSafe(F.col("after")))


def report(books: DataFrame, chapters: DataFrame, logs: DataFrame, n: int = 10) -> DataFrame:
    """Every book with its counts, its issues and its n newest log ids."""
    issues = validate(books, chapters).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("level", "code", "n"))).alias("issues"))
    newest = recent(logs, n).groupBy("book_id").agg(F.sort_array(F.collect_list("id"), asc=False).alias("logs"))
    out = list_books(books, chapters).join(issues, "book_id", "left").join(newest, "book_id", "left")
    return out.withColumn("issues", F.coalesce("issues", F.array().cast("array<struct<level:string,code:string,n:bigint>>"))).withColumn("logs", F.coalesce("logs", F.array().cast("array<bigint>")))


def fresh_pages(pages: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Non-empty pages retrieved in the last `days` days."""
    return pages.filter((F.length("html") > 0) & (F.col("retrieved_at") >= now - F.make_dt_interval(F.lit(days))))


def delete_plan(books: DataFrame, chapters: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of each table that deletion removes."""
    keys = gone.select("book_id").distinct()
    count = lambda df, name: df.join(keys, "book_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
    return count(books, "books").unionByName(count(chapters, "chapters"))

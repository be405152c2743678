"""Speech jobs: ingest, status and subtitle timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


def ingest(chapters: DataFrame, known: DataFrame | None = None, settings: str = "") -> DataFrame:
    """Jobs of chapters (book_id, chapter_id, chapter_number, chapter_title,
    content): QUEUED from five characters on, else SKIPPED; one job for each
    (book, chapter, content, settings), the first by number."""
    content = text.normalize_markup(F.coalesce("content", F.lit("")))
    number = F.col("chapter_number")
    jobs = chapters.select(
        "book_id", F.coalesce("chapter_id", number.cast("string")).alias("chapter_id"), "chapter_number",
        F.coalesce(F.nullif("chapter_title", F.lit("")), F.concat(F.lit("第"), number.cast("string"), F.lit("章"))).alias("chapter_title"),
        content.alias("content"), F.lit(settings).alias("settings_hash"),
    )
    jobs = jobs.withColumn("content_hash", F.sha2("content", 256)).withColumn("status", F.when(F.length("content") >= 5, "QUEUED").otherwise("SKIPPED"))
    key = ["book_id", "chapter_id", "content_hash", "settings_hash"]
    first = Window.partitionBy(*key).orderBy("chapter_number")
    jobs = jobs.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return jobs if known is None else jobs.join(known.select(*key), key, "left_anti")


def book_status(jobs: DataFrame) -> DataFrame:
    finished = F.col("status").isin("COMPLETED", "SKIPPED")
    return jobs.groupBy("book_id").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(finished).alias("finished")).withColumn("status", F.when(F.col("jobs") == F.col("finished"), "COMPLETED").otherwise("INCOMPLETE"))


def timeline(chapters: DataFrame) -> DataFrame:
    """Adds to chapters (book_id, number, duration) the offset: the sum of the
    durations before it."""
    before = Window.partitionBy("book_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return chapters.withColumn("offset", F.coalesce(F.sum("duration").over(before), F.lit(0.0)))


def retry(attempts: DataFrame, retries: int) -> DataFrame:
    wait = F.col("attempt") < retries
    return attempts.withColumn("status", F.when(wait, "RETRY_WAIT").otherwise("FAILED")).withColumn("backoff", F.when(wait, F.least(F.pow(F.lit(2), F.col("attempt")), F.lit(30.0))))


def group_progress(files: DataFrame, manifests: DataFrame, now) -> DataFrame:
    """Status and phase of each group of files (output, group, folder, name,
    modified) and manifests (output, group, status, assembled boolean)."""
    has = lambda ext: F.max(F.coalesce((F.col("folder") == "assembled") & (F.col("name") == F.concat("group", F.lit(ext))), F.lit(False)))
    pieces = lambda ext: F.count_if((F.col("folder") == "chapters") & F.col("name").endswith(ext))
    m4b_at = F.max(F.when((F.col("folder") == "assembled") & F.col("name").endswith(".m4b"), F.col("modified")))
    facts = files.groupBy("output", "group").agg(has(".mp3").alias("mp3"), has(".srt").alias("srt"), has(".m4b").alias("m4b"), pieces(".mp3").alias("chapter_mp3"), pieces(".srt").alias("chapter_srt"), m4b_at.alias("m4b_at"))
    known = manifests.select("output", "group", F.col("status").alias("manifest"), "assembled")
    joined = facts.join(known, ["output", "group"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    recent = yes(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("m4b_at").cast("timestamp")) < 180_000_000) & F.col("m4b")
    mp3, both = F.col("mp3"), F.col("mp3") & F.col("srt")
    cases = [
        (yes(F.col("manifest") == "INCOMPLETE"), "failed", "failed"), (yes(F.col("assembled")), "completed", "completed"), (recent, "running", "m4b_transcoding"), (both & F.col("m4b"), "completed", "completed"),
        (both, "running", "m4b_pending"), (mp3 & (F.col("chapter_mp3") >= 1), "running", "assembling"), (F.col("chapter_mp3") >= 1, "running", "chapters"),
        (yes(F.col("manifest") == "COMPLETED") & mp3 & F.col("m4b"), "completed", "completed"),
    ]
    status, phase = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for test, s, p in cases:
        status, phase = status.when(test, s), phase.when(test, p)
    return joined.select("output", "group", status.otherwise("empty").alias("status"), phase.otherwise("pending").alias("phase"), "chapter_mp3", "chapter_srt")


def output_progress(groups: DataFrame) -> DataFrame:
    """Counts and current group of each output: the first that runs, else the
    first that is neither complete nor empty."""
    first = lambda test: F.min_by(F.struct("group", "phase"), F.when(test, F.col("group")))
    current = F.coalesce(first(F.col("status") == "running"), first(~F.col("status").isin("completed", "empty")))
    out = groups.groupBy("output").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.max(F.col("status") == "running").alias("running"), current.alias("c"))
    return out.select("output", "total", "completed", "failed", "running", F.col("c.group").alias("current_group"), F.coalesce("c.phase", F.lit("idle")).alias("current_phase"))


def manifests(jobs: DataFrame) -> DataFrame:
    """(book_id, status, manifest): a JSON text with the jobs in order; COMPLETED
    where every job is completed or skipped."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("chapter_number", "chapter_id", "chapter_title", "status"))), lambda x: x)
    out = jobs.groupBy("book_id").agg(rows.alias("chapters"), F.min(F.col("status").isin("COMPLETED", "SKIPPED")).alias("_all"))
    out = out.withColumn("status", F.when(F.col("_all"), "COMPLETED").otherwise("INCOMPLETE"))
    return out.select("book_id", "status", F.to_json(F.struct("book_id", "status", "chapters")).alias("manifest"))

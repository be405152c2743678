"""Task histories: audits and current states.

events: task_id, task_version, from_status, to_status, created_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_STOPS = "paused terminal_failed cancelled"
#: Allowed moves between statuses (fixed values).
TRANSITIONS = {
    "created": "probing paused cancelled",
    "probing": f"waiting_for_user validating recoverable_failed {_STOPS}",
    "waiting_for_user": f"validating crawling recoverable_failed {_STOPS}",
    "validating": f"probing waiting_for_user ready recoverable_failed {_STOPS}",
    "ready": f"crawling recoverable_failed {_STOPS}",
    "crawling": f"completed waiting_for_user recoverable_failed {_STOPS}",
    "paused": "created probing waiting_for_user validating ready crawling cancelled",
    "recoverable_failed": "probing waiting_for_user validating ready crawling terminal_failed cancelled",
}
TERMINAL = ("completed", "terminal_failed", "cancelled")


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, many in TRANSITIONS.items() for b in many.split()], "from_status string, to_status string")


def _by_version():
    return Window.partitionBy("task_id").orderBy("task_version")


def audit_transitions(events: DataFrame) -> DataFrame:
    """Moves that the graph does not allow: with code terminal_exit after a
    terminal status, first_status for a first that is not created, else
    illegal_transition. The graph is a fixed table of a few dozen rows."""
    allowed = F.broadcast(transitions(events.sparkSession).withColumn("ok", F.lit(True)))
    moved = events.withColumn("from_status", F.lag("to_status").over(_by_version()))
    found = moved.join(allowed, ["from_status", "to_status"], "left").filter("ok is null")
    code = F.when(F.col("from_status").isin(*TERMINAL), "terminal_exit").when(F.col("from_status").isNull(), F.when(F.col("to_status") != "created", F.lit("first_status"))).otherwise("illegal_transition")
    return found.withColumn("code", code).filter(F.col("code").isNotNull()).select("task_id", "task_version", "from_status", "to_status", "code")


def chain_integrity(events: DataFrame) -> DataFrame:
    """Per task: whether versions run 0, 1, ... and each from is the last to."""
    w = _by_version()
    step = events.withColumn("prev", F.lag("to_status").over(w)).withColumn("rn", F.row_number().over(w) - 1)
    good = (F.col("task_version") == F.col("rn")) & F.col("prev").eqNullSafe(F.col("from_status"))
    return step.groupBy("task_id").agg(F.count(F.lit(1)).alias("events"), F.min(good).alias("intact"))


def current_state(events: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("to_status", "created_at"), "task_version").alias("s")
    return events.groupBy("task_id").agg(last, F.max("task_version").alias("version")).select("task_id", "version", F.col("s.to_status").alias("status"), F.col("s.to_status").isin(*TERMINAL).alias("terminal"))


def resume_status(events: DataFrame) -> DataFrame:
    """The status a paused or failed task came from."""
    last = events.groupBy("task_id").agg(F.max_by(F.struct("from_status", "to_status"), "task_version").alias("s"))
    return last.filter(F.col("s.to_status").isin("paused", "recoverable_failed")).select("task_id", F.col("s.from_status").alias("resume_status"))


def version_conflicts(events: DataFrame) -> DataFrame:
    return events.groupBy("task_id", "task_version").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphaned_waiting(tasks: DataFrame, leases: DataFrame, now) -> DataFrame:
    """Waiting tasks without a lease that still runs."""
    live = leases.filter(F.col("expires_at") > F.lit(now)).select("task_id")
    return tasks.filter(F.col("status") == "waiting_for_user").join(live, "task_id", "left_anti")


def claimable(chapters: DataFrame, owner: str, now: float) -> DataFrame:
    free = F.col("claim_owner").isNull() | (F.col("claim_owner") == owner) | (F.col("claim_until") <= now)
    return chapters.filter((F.col("status") != "done") & free)


def gaps(requests: DataFrame, hours: int = 24) -> DataFrame:
    """Requests (host, ts, id) with gap_us, the time since the one before of its
    host (ties by id), null for the first and where a time is null. A host's
    requests are taken by spans of some hours, so a host of a third of all rows
    is dealt to as many tasks as it has spans: within a span by a window, across
    spans by the last time of each, one row a host and span."""
    timed = requests.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    timed = timed.withColumn("_span", F.struct("host", F.expr(f"_us div {hours * 3_600_000_000}").alias("n")))  # a struct: null hosts meet too
    within = Window.partitionBy("_span").orderBy("_us", "id")
    ends = timed.groupBy("_span").agg(F.max("_us").alias("_end"))
    last = F.lag("_end").over(Window.partitionBy("_span.host").orderBy("_span.n"))
    before = timed.withColumn("_before", F.lag("_us").over(within)).withColumn("_k", F.row_number().over(within))
    met = before.join(ends.select("_span", last.alias("_last")), "_span", "left")
    return met.select(*requests.columns, (F.col("_us") - F.when(F.col("_k") == 1, F.col("_last")).otherwise(F.col("_before"))).alias("gap_us"))


def politeness(requests: DataFrame, seconds: float) -> DataFrame:
    """Requests (host, ts, id) that follow another of their host too soon."""
    return gaps(requests).filter(F.col("gap_us") < int(seconds * 1e6))


def interval_at(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds min_seconds and pause_seconds to requests (host, ts): what intervals
    (host, since, min_seconds, pause_seconds) say of the host from `since` on,
    the last that is not after ts. Null where none holds. Each host's changes
    are few and lie in one row, so streams can be joined too."""
    changes = intervals.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("since", "min_seconds", "pause_seconds"))).alias("_changes"))
    valid = F.element_at(F.filter("_changes", lambda c: c["since"] <= F.col("ts")), -1)
    valid = F.when(F.exists("_changes", lambda c: c["since"] <= F.col("ts")), valid)
    joined = requests.join(changes, "host", "left").withColumn("_valid", valid)
    return joined.select(*requests.columns, "_valid.min_seconds", "_valid.pause_seconds")


def impolite(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """Requests (host, ts, id) that follow another of their host sooner than the
    interval valid at their time; hosts without one have none."""
    return interval_at(gaps(requests), intervals).filter(F.col("gap_us") < (F.col("min_seconds") * 1_000_000).cast("long"))


def visits(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """(host, first, last, requests): runs of requests of a host without a long
    pause: each goes on while the next request comes within the pause_seconds
    valid at a request of it, or just then. Hosts without an interval have none. Also on a
    stream with a watermark on ts."""
    timed = interval_at(requests, intervals).filter("pause_seconds is not null")
    gap = F.concat((F.col("pause_seconds") * 1_000_000).cast("long").cast("string"), F.lit(" microseconds"))
    return timed.groupBy("host", F.session_window("ts", gap)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("requests")).select("host", "first", "last", "requests")


def pauses(visited: DataFrame) -> DataFrame:
    """(host, began, ended, pause_us): long pauses between visits."""
    before = F.lag("last").over(Window.partitionBy("host").orderBy("first"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return visited.withColumn("began", before).filter("began is not null").select("host", "began", F.col("first").alias("ended"), (us("first") - us("began")).alias("pause_us"))


def fenced(claims: DataFrame, writes: DataFrame) -> DataFrame:
    """Every write (book_id, chapter_index, write_id, at, owner, generation,
    token; the last three null where it names no claim) with the code of its
    refusal, null where it stands. Claims (book_id, chapter_index, owner,
    generation, token, at, expires_at) hold from `at` until the next of their
    chapter or until they expire; of claims and writes of one instant the claims
    are first. One pass over each chapter's history in order: the last claim
    before a write is the one that held.

    unclaimed_write: no claim is named while one runs; no_claim: none was ever
    made; expired_claim: the holder's has run out; stale_generation, wrong_owner
    and wrong_token: it differs from the holder's."""
    held = F.struct("owner", "generation", "token", "expires_at")
    key = ["book_id", "chapter_index"]
    log = claims.select(*key, "at", F.lit(0).alias("_kind"), F.col("generation").alias("_order"), held.alias("_claim")).unionByName(
        writes.select(*key, "at", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_order"), "write_id", "owner", "generation", "token"), allowMissingColumns=True
    )
    order = Window.partitionBy(*key).orderBy("at", "_kind", "_order").rowsBetween(Window.unboundedPreceding, 0)
    met = log.withColumn("h", F.last("_claim", ignorenulls=True).over(order)).filter("_kind = 1")
    active = F.coalesce(F.col("h.expires_at") > F.col("at"), F.lit(False))
    differs = lambda name: ~F.col(name).eqNullSafe(F.col(f"h.{name}"))
    code = (
        F.when(F.col("generation").isNull() & F.col("owner").isNull() & F.col("token").isNull(), F.when(active, "unclaimed_write"))
        .when(F.col("h").isNull(), "no_claim").when(differs("generation"), "stale_generation").when(differs("owner"), "wrong_owner").when(differs("token"), "wrong_token").when(~active, "expired_claim")
    )
    return met.select(*key, "write_id", "at", code.alias("code"))


def rates(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events by status and time window; also on a stream with a watermark."""
    return events.groupBy(F.window("created_at", width).alias("w"), "to_status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "to_status", "n")

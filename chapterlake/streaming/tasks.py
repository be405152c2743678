"""Streams: event rates with a watermark, live task states, intake of pages and
of chapters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from ..functions import urls
from ..operators import events, pages
from ..sources.shared import keep, new_folder
from ..sources.tables import KeyedTable


def event_rates(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling counts by status; rows later than `late` are dropped."""
    return events.rates(stream.withWatermark("created_at", late), width)


def _canonical(captured: DataFrame) -> DataFrame:
    return captured.withColumn("canonical_url", urls.canonical_url(F.col("url"))).filter(F.col("canonical_url").isNotNull())


def page_intake(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Valid pages (url, retrieved_at, ...) once for each canonical URL."""
    return _canonical(stream).withWatermark("retrieved_at", late).dropDuplicatesWithinWatermark(["canonical_url"])


class TaskProcessor(StatefulProcessor):
    """The live state of one task: its row, events that came before those they
    follow, and one timer while it waits. A batch's events are held by version
    and status number, 9 bytes each, and put in order at its end."""

    def __init__(self, wait_ms: int, early: int, by_event: bool):
        self.wait_ms, self.early, self.by_event = wait_ms, early, by_event
        self.moves = {a: frozenset(many.split()) for a, many in events.TRANSITIONS.items()}
        self.names = sorted({*self.moves, *events.TERMINAL})

    def init(self, handle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "status string, version long, resume_status string, deadline long")
        self.waiting = handle.getListState("waiting", "version long, status string")

    def _now(self, times) -> int:
        return times.getCurrentWatermarkInMs() if self.by_event else times.getCurrentProcessingTimeInMs()

    def _shown(self, key, status, version, resume, code) -> pd.DataFrame:
        return pd.DataFrame({"task_id": [key[0]], "version": [version], "status": [status], "resume_status": [resume], "code": [code]})

    def _moved(self, status, version, resume, events):
        """A task behind its events, in order of their versions: its status,
        version, status to resume, the code of what was refused and what came early."""
        code, left = None, []
        for v, name in events:
            if v > version + 1 and len(left) < self.early:
                left.append((v, name))
            elif v != version + 1:
                code = "version_conflict"
            elif name not in (self.moves.get(status, ()) if status else ("created",)):
                code = "illegal_transition"
            else:
                resume = status if name in ("paused", "recoverable_failed") else None
                status, version = name, v
        return status, version, resume, code, left

    def _until(self, status, newest, now) -> int | None:
        """When the wait of a task ends that waits since its newest event."""
        if status != "waiting_for_user":
            return None
        timed = self.by_event and newest is not None and newest == newest
        return max((int(newest.astype("datetime64[ms]").astype(np.int64)) if timed else now) + self.wait_ms, now + 1)

    def _wait_until(self, old: int | None, new: int | None) -> None:
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None and old != new:
            self.handle.registerTimer(new)

    def handleInputRows(self, key, rows, timerValues):
        status, version, resume, deadline = self.row.get() if self.row.exists() else (None, -1, None, None)
        number = {s: k for k, s in enumerate(self.names)}
        versions, statuses, other, newest = [], [], {}, None
        for at, to in self.waiting.get() if self.waiting.exists() else ():
            versions.append(np.array([at], np.int64))
            statuses.append(np.array([number.get(to, -1)], np.int8))
        for part in rows:
            at, to, when = (part[c].to_numpy() for c in ("task_version", "to_status", "created_at"))
            if at.dtype.kind == "f":  # some are null
                some = ~np.isnan(at)
                at, to = at[some].astype(np.int64), to[some]
            known = np.array([number.get(x, -1) for x in to.tolist()], np.int8)
            other |= {int(v): x for v, x, k in zip(at, to, known) if k < 0}
            versions.append(at)
            statuses.append(known)
            last = when.max()
            newest = last if newest is None or last > newest else newest
        at, to = np.concatenate(versions), np.concatenate(statuses)
        order = np.argsort(at, kind="stable")
        names = (self.names[s] if s >= 0 else other.get(v) for v, s in zip(at[order].tolist(), to[order].tolist()))
        status, version, resume, code, left = self._moved(status, version, resume, zip(at[order].tolist(), names))
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        until = self._until(status, newest, self._now(timerValues))
        self._wait_until(deadline, until)
        if status is not None:
            self.row.update((status, version, resume, until))
        yield self._shown(key, status, version, resume, code)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        status, version, _, deadline = self.row.get() if self.row.exists() else (None, -1, None, None)
        if status != "waiting_for_user" or deadline != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.row.update(("recoverable_failed", version + 1, status, None))
        yield self._shown(key, "recoverable_failed", version + 1, status, "wait_expired")

    def close(self) -> None:
        pass


#: Of a bucket's state: a row a task, by id.
_HELD = pa.schema([("task_id", pa.string()), ("status", pa.string()), ("version", pa.int64()), ("resume_status", pa.string()), ("deadline", pa.int64()), ("early", pa.list_(pa.int64())), ("early_status", pa.list_(pa.string()))])


class TaskBuckets(TaskProcessor):
    """The live states of the tasks of one bucket, packed as one value, with one
    timer at the earliest end of a wait: a batch calls for a bucket's state once,
    not for each task's. A task moves as TaskProcessor has it."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tasks", "packed binary, timer long")

    def _read(self) -> tuple[dict, int | None]:
        if not self.state.exists():
            return {}, None
        packed, timer = self.state.get()
        columns = pa.ipc.open_stream(bytes(packed)).read_all().to_pydict()
        return {k: (*row, list(zip(at, to))) for k, *row, at, to in zip(*columns.values())}, timer

    def _write(self, tasks: dict, timer: int | None) -> None:
        first = min((t[3] for t in tasks.values() if t[3] is not None), default=None)
        self._wait_until(timer, first)
        columns = [list(tasks), *([t[k] for t in tasks.values()] for k in range(4)), *([[e[k] for e in t[4]] for t in tasks.values()] for k in range(2))]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD) as out:
            out.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HELD)], schema=_HELD))
        self.state.update((sink.getvalue().to_pybytes(), first))

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["task_id", "version", "status", "resume_status", "code"], dtype=object).astype({"version": np.int64})

    def handleInputRows(self, key, rows, timerValues):
        tasks, timer = self._read()
        now, shown = self._now(timerValues), []
        ids, place = [], {}  # of the batch's tasks
        parts = []
        number = {s: k for k, s in enumerate(self.names)}
        for part in rows:
            codes, own = pd.factorize(part["task_id"], use_na_sentinel=False)
            own = [None if x != x else x for x in own]
            for task in own:
                if task not in place:
                    place[task] = len(ids)
                    ids.append(task)
            at, to = part["task_version"].to_numpy(), part["to_status"].to_numpy()
            whole = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), bool)  # some are null
            for s in pd.unique(to):
                number.setdefault(s, len(number))
            parts.append((np.array([place[t] for t in own], np.int64)[codes], np.where(whole, at, 0).astype(np.int64), whole, np.array([number[s] for s in to], np.int32), part["created_at"].to_numpy()))
        owner, at, whole, to, when = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((at, owner))
        owner, at, whole, to, when = owner[order], at[order], whole[order], to[order], when[order]
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        newest, said = np.fmax.reduceat(when, begins), list(number)
        for lo, hi, k, last in zip(begins.tolist(), [*begins[1:].tolist(), len(owner)], owner[begins].tolist(), newest):
            status, version, resume, _, early = tasks.get(ids[k]) or (None, -1, None, None, [])
            came = zip(at[lo:hi][whole[lo:hi]].tolist(), (said[s] for s in to[lo:hi][whole[lo:hi]].tolist()))
            events = sorted([*early, *came], key=lambda e: e[0]) if early else came
            status, version, resume, code, left = self._moved(status, version, resume, events)
            if status is not None or left:
                tasks[ids[k]] = (status, version, resume, self._until(status, last, now), left)
            shown.append((ids[k], version, status, resume, code))
        self._write(tasks, timer)
        yield self._frame(shown)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        tasks, timer = self._read()
        if timer is None or timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        passed = max(timer, self._now(timerValues) - 1)
        gone = [k for k, t in tasks.items() if t[3] is not None and t[3] <= passed]
        for k in gone:
            status, version, _, _, early = tasks[k]
            tasks[k] = ("recoverable_failed", version + 1, status, None, early)
        self._write(tasks, None)  # the timer that held is over
        yield self._frame([(k, tasks[k][1], tasks[k][0], tasks[k][2], "wait_expired") for k in gone])


def task_states(stream: DataFrame, wait: str = "30 minutes", late: str | None = None, early: int = 0, buckets: int = 1024) -> DataFrame:
    """Live state of tasks from events (task_id, task_version, to_status,
    created_at): per batch and task its status, version, the status to resume
    and the code of what was refused. Events apply in version order; a version
    that does not follow is a version_conflict, a move outside the graph an
    illegal_transition. Up to `early` events of a task that come a batch too
    early wait for those before them. A waiting task without an event for
    `wait` fails with wait_expired: by the clock, or with `late` by event time,
    once the watermark (`late` behind the newest event) passes its last event
    by `wait`. Events later than `late` are then dropped. Events of a null
    version are passed over.

    Tasks lie in buckets by the hash of their id; a batch reads and writes the
    states of the buckets that its events fall in, whose number is to be chosen
    for that of the tasks. The state needs RocksDB: start such a stream by start()."""
    processor = TaskBuckets(int(pd.Timedelta(wait) // pd.Timedelta(milliseconds=1)), early, late is not None)
    kind = stream.schema["task_id"].dataType.simpleString()
    shape = "task_id string, version long, status string, resume_status string, code string"
    timed = stream.withWatermark("created_at", late) if late else stream
    dealt = timed.select(F.pmod(F.xxhash64("task_id"), F.lit(buckets)).alias("bucket"), F.col("task_id").cast("string"), "task_version", "to_status", "created_at")
    found = dealt.groupBy("bucket").transformWithStateInPandas(processor, shape, "Update", "EventTime" if late else "ProcessingTime")
    return found.withColumn("task_id", F.col("task_id").cast(kind))


#: Before every time, so that a gap to it still fits 64 bits.
_NEVER = -(1 << 62)


def _judged(held: np.ndarray, last: int, timed: int, reach: int) -> tuple[tuple[int, int, int], list[tuple]]:
    """What stays of a host behind requests (us, id, least, pause), and those
    that came too soon or after a long pause: (code, us, ids, gaps)."""
    us, ids, least, pause = held[np.lexsort((held[:, 1], held[:, 0]))].T
    gap = np.diff(us, prepend=last)
    soon = gap < least
    known = np.flatnonzero(pause >= 0)
    reached = np.maximum.accumulate(np.concatenate([[reach], us[known] + pause[known]]))
    before = np.concatenate([[timed], us[known]])
    away = (us[known] > reached[:-1]) & (before[:-1] != _NEVER)
    found = [(code, us[at], ids[at], gaps) for code, at, gaps in (("too_soon", np.flatnonzero(soon), gap[soon]), ("long_pause", known[away], np.diff(before)[away])) if len(at)]
    return (int(us[-1]), int(before[-1]), int(reached[-1])), found


class GapProcessor(StatefulProcessor):
    """The requests of one host, in order of their times: those that the
    watermark has passed have all come and are judged; the others wait, with one
    timer at the earliest. What stays of the judged is the last time of all, the
    last of those under an interval and how far their visit reaches."""

    def init(self, handle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "last long, timed long, reach long, timer long")
        self.held = handle.getListState("held", "us long, id long, least long, pause long")

    def _row(self):
        return self.row.get() if self.row.exists() else (_NEVER, _NEVER, _NEVER, None)

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for part in rows:
            came = part[["us", "id", "least", "pause"]].to_numpy(np.int64)
            self.held.appendList([tuple(r) for r in came.tolist()])
            least = int(came[:, 0].min())
            first = least if first is None else min(first, least)
        if first is not None:
            last, timed, reach, timer = self._row()
            due = -(-first // 1000)
            if timer is None or due < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
                timer = due
            self.row.update((last, timed, reach, timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, timed, reach, timer = self._row()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        held = np.array(list(self.held.get()), np.int64).reshape(-1, 4)
        passed = held[:, 0] <= 1000 * max(timerValues.getCurrentWatermarkInMs(), timer)
        left, held = held[~passed], held[passed]
        (last, timed, reach), found = _judged(held, last, timed, reach)
        timer = None
        if len(left):
            self.held.put([tuple(r) for r in left.tolist()])
            timer = int(-(-left[:, 0].min() // 1000))
            self.handle.registerTimer(timer)
        else:
            self.held.clear()
        self.row.update((last, timed, reach, timer))
        for code, us, ids, gaps in found:
            yield pd.DataFrame({"host": [key[0]] * len(us), "us": us, "id": ids, "gap_us": gaps, "code": code})

    def close(self) -> None:
        pass


class GapBuckets(StatefulProcessor):
    """The requests of the hosts of one bucket as one state, with one timer at
    the earliest of all; each host is judged as GapProcessor has it. hosts: name,
    last, timed and reach of each; held: us, id, least, pause and the host's place."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "names array<string>, rows binary, held binary, timer long")

    def _read(self):
        if not self.state.exists():
            return [], np.empty((0, 3), np.int64), np.empty((0, 5), np.int64), None
        names, rows, held, timer = self.state.get()
        numbers = lambda packed, width: np.frombuffer(bytes(packed), "<i8").reshape(-1, width)
        return list(names), numbers(rows, 3), numbers(held, 5), timer

    def _write(self, names, rows, held, timer) -> None:
        """States the bucket anew; its timer is at the earliest request held."""
        due = int(-(-held[:, 0].min() // 1000)) if len(held) else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((names, rows.astype("<i8").tobytes(), held.astype("<i8").tobytes(), due))

    def handleInputRows(self, key, rows, timerValues):
        names, kept, held, timer = self._read()
        place, parts = {h: k for k, h in enumerate(names)}, [held]
        for part in rows:
            codes, own = pd.factorize(part["host"])
            places = np.array([place.setdefault(h, len(place)) for h in own], np.int64)
            parts.append(np.column_stack([part[["us", "id", "least", "pause"]].to_numpy(np.int64), places[codes]]))
        new = np.full((len(place) - len(names), 3), _NEVER, np.int64)
        self._write(list(place), np.concatenate([kept, new]), np.concatenate(parts), timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        names, kept, held, timer = self._read()
        if timer is None or timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        passed = held[:, 0] <= 1000 * max(timerValues.getCurrentWatermarkInMs(), timer)
        left, held = held[~passed], held[passed]
        held, kept, out = held[np.argsort(held[:, 4], kind="stable")], kept.copy(), []
        begins = np.flatnonzero(np.diff(held[:, 4], prepend=-1))
        for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(held)]):
            k = int(held[lo, 4])
            kept[k], found = _judged(held[lo:hi, :4], *kept[k].tolist())
            out += [(np.full(len(us), k), us, ids, gaps, np.full(len(us), code, object)) for code, us, ids, gaps in found]
        self._write(names, kept, left, None)  # the timer that held is over
        if out:
            host, us, ids, gaps, code = (np.concatenate(c) for c in zip(*out))
            yield pd.DataFrame({"host": np.array(names, object)[host], "us": us, "id": ids, "gap_us": gaps, "code": code})

    def close(self) -> None:
        pass


def request_gaps(stream: DataFrame, intervals: DataFrame, late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """(host, ts, id, gap_us, code) of a stream of requests (host, ts, id long):
    too_soon where one follows another of its host sooner than the interval of
    intervals (see events.interval_at) valid at its time; long_pause where it
    begins a visit that is not the first (see events.visits), with the time since
    the visit before. A request is judged once the watermark, `late` behind the
    newest, has passed it: all before it have then come; those later than `late`
    are dropped. Requests without host, time or id are passed over.

    Hosts lie in buckets by their hash, whose number is to be chosen for that of
    the hosts; requests of the last `late` wait in a bucket's state, 40 bytes
    each. The state needs RocksDB: start such a stream by start()."""
    some = stream.withWatermark("ts", late).filter("host is not null and ts is not null and id is not null")
    us = lambda c: F.coalesce((F.col(c) * 1_000_000).cast("long"), F.lit(-1))
    rows = events.interval_at(some, intervals).select("host", "ts", F.col("id").cast("long").alias("id"), F.unix_micros("ts").alias("us"), us("min_seconds").alias("least"), us("pause_seconds").alias("pause"))
    kind = stream.schema["host"].dataType.simpleString()
    dealt = rows.withColumns({"bucket": F.pmod(F.xxhash64("host"), F.lit(buckets)), "host": F.col("host").cast("string")})
    found = dealt.groupBy("bucket").transformWithStateInPandas(GapBuckets(), "host string, us long, id long, gap_us long, code string", "Append", "EventTime")
    return found.select(F.col("host").cast(kind).alias("host"), F.timestamp_micros("us").alias("ts"), "id", "gap_us", "code")


#: Settings of streams while they start (a query keeps those it started with):
#: states in RocksDB, written as changes; and without checksum files, which
#: Spark 4.1 writes in a pool of a few threads, in which more stateful tasks
#: than threads wait for ever.
STREAMS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}


def start(spark: SparkSession, writer):
    """Starts a stream under STREAMS; the session's own settings stay."""
    had = {k: spark.conf.get(k, None) for k in STREAMS}
    try:
        for k, v in STREAMS.items():
            spark.conf.set(k, v)
        return writer.start()
    finally:
        for k, v in had.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _first_captures(batch: DataFrame, seen: KeyedTable, batch_id: int, late: str = "1 day") -> DataFrame:
    """The earliest capture of each canonical URL of a batch, the least page_id
    of those of one time; not those within `late` after the capture taken last,
    or before it. What is taken is noted."""
    order = Window.partitionBy("canonical_url").orderBy(F.col("retrieved_at").asc_nulls_last(), "page_id")
    first = keep(batch.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n"))
    known = seen.near(first, batch_id).select("canonical_url", F.col("retrieved_at").alias("_at"), F.lit(True).alias("_known"))
    again = F.col("_known").isNull() | (F.col("retrieved_at") >= F.col("_at") + F.expr(f"interval {late}"))
    new = keep(first.join(known, "canonical_url", "left").filter(again).drop("_at", "_known"))
    seen.merge(new.select("canonical_url", "retrieved_at"), batch_id)
    return new


def _classified(batch: DataFrame, hashes: KeyedTable, batch_id: int) -> DataFrame:
    """New contents of a batch with their classes; their hashes are noted."""
    hashed = keep(batch.withColumn("content_hash", F.sha2(F.coalesce("html", F.lit("")), 256)))
    first = hashed.groupBy("content_hash").agg(F.min("page_id").alias("page_id"))
    new = hashed.join(first, ["content_hash", "page_id"], "left_semi")
    new = keep(new.join(hashes.near(hashed, batch_id).select("content_hash"), "content_hash", "left_anti"))
    kinds = pages.classify(new, keep(pages.flatten(new))).select("page_id", "kind", "confidence")
    hashes.merge(new.select("content_hash", F.lit(batch_id).cast("long").alias("batch")), batch_id)
    return new.join(kinds, "page_id", "left")


def intake(captured: DataFrame, target: str, checkpoint: str, trigger: dict | None = None, buckets: int = 64):
    """Runs page intake into a Parquet folder. Of pages with page_id and html the
    earliest capture of a canonical URL is taken, by a keyed table of URLs, so
    that rows do not depend on the order in which they came; they get their class (kind, confidence) and the hash of their content; those whose
    content an earlier page has are refused: hashes lie in a keyed table beside
    the target, of which a batch reads the buckets of its own hashes. Each
    micro-batch is written once under its batch id, so a batch that is repeated
    after a failure replaces itself. Progress is in the checkpoint folder."""
    hashes = KeyedTable(captured.sparkSession, f"{target}_hashes", ["content_hash"], "content_hash string, batch long", buckets)
    seen = KeyedTable(captured.sparkSession, f"{target}_urls", ["canonical_url"], "canonical_url string, retrieved_at timestamp", buckets)
    whole = {"page_id", "html"} <= set(captured.columns)

    def write(batch, batch_id):
        if batch.isEmpty():
            return
        out = _classified(_first_captures(batch, seen, batch_id), hashes, batch_id) if whole else batch
        out.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    taken = _canonical(captured) if whole else page_intake(captured)
    return start(captured.sparkSession, taken.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})))


CHAPTERS = "id string, book_id long, chapter_index long, title string, canonical_url string, status string, content_hash string, error string"


class ChapterStore:
    """Chapters that streams write: rows by index, and which chapter a url and a
    content is bound to, each a keyed table."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        table = lambda name, keys, schema: KeyedTable(spark, f"{path}/{name}", keys, schema, buckets)
        self.by_index = table("index", ["book_id", "chapter_index"], CHAPTERS)
        self.by_url = table("url", ["book_id", "canonical_url"], "book_id long, canonical_url string, chapter_index long")
        self.by_content = table("content", ["book_id", "content_hash"], "book_id long, content_hash string, chapter_index long")

    def read(self) -> DataFrame:
        return self.by_index.read()

    def _taken(self, new: DataFrame, batch: int) -> DataFrame:
        """Incoming rows whose url another chapter has, or an earlier row."""
        key = ["book_id", "canonical_url"]
        bound = self.by_url.near(new, batch).select(*key, F.col("chapter_index").alias("_bound"))
        nth = F.row_number().over(Window.partitionBy(*key).orderBy("position", "row"))
        placed = new.select(*key, "chapter_index", "position", "row").withColumn("_u", nth).join(bound, key, "left")
        return keep(placed.filter("_u > 1 or _bound <> chapter_index").select("row", F.lit(True).alias("_taken")))

    def _states(self, new: DataFrame, batch: int) -> DataFrame:
        """Each incoming chapter that is known or can be put in, as its row and
        its body leave it; `waits` if its body may be another chapter's. Rows
        that stay as they are have keys and hash alone."""
        key = ["book_id", "chapter_index"]
        nth = F.row_number().over(Window.partitionBy(*key).orderBy("position", "row"))
        first = new.withColumn("_i", nth).filter("_i = 1").drop("_i", "position")
        here = self.by_index.near(new, batch).join(new.select(*key), key, "left_semi")
        here = here.select(*key, F.col("title").alias("_title"), F.col("canonical_url").alias("_url"), F.col("status").alias("_status"), F.unhex("content_hash").alias("_hash"), F.col("error").alias("_error"))
        joined = first.join(here, key, "left").join(self._taken(new, batch), "row", "left")
        known, done, has = F.col("_status").isNotNull(), F.coalesce(F.col("_status") == "done", F.lit(False)), F.col("hash").isNotNull()
        put = F.col("_taken").isNull() & ~done
        code = F.when(has & F.col("empty"), "chapter_content_empty").when(has & done & ~F.coalesce(F.col("_hash") == F.col("hash"), F.lit(False)), "chapter_content_conflict")
        made = joined.filter(known | put).select(
            *key, "hash", (has & ~F.col("empty") & ~done).alias("waits"), F.when(put, F.col("title")).otherwise(F.col("_title")).alias("title"), F.when(put, F.col("canonical_url")).otherwise(F.col("_url")).alias("canonical_url"),
            F.coalesce("_status", F.lit("pending")).alias("status"), F.col("_hash").alias("old_hash"), F.coalesce(code, F.col("_error")).alias("error"), "_title", F.col("_url").alias("old_url"), "_error", known.alias("_known"),
        )
        kept = F.col("_known") & F.col("title").eqNullSafe(F.col("_title")) & F.col("canonical_url").eqNullSafe(F.col("old_url")) & F.col("error").eqNullSafe(F.col("_error"))
        made = made.withColumn("waits", F.coalesce("waits", F.lit(False))).withColumn("changed", ~kept).filter("changed or hash is not null")
        shown = [F.when(F.col("changed") | F.col("waits"), F.col(c)).alias(c) for c in ("title", "canonical_url", "status", "old_hash", "error", "old_url")]
        return keep(made.select(*key, "hash", "waits", "changed", *shown), compression="zstd")

    def _repeated(self, states: DataFrame, batch: int) -> DataFrame:
        """Waiting chapters whose body a chapter of the book has, or one of lower
        id in the batch."""
        waiting = states.filter("waits").select("book_id", "hash")
        held = self.by_content.near(waiting.select("book_id", F.lower(F.hex("hash")).alias("content_hash")), batch)
        held = held.select("book_id", F.unhex("content_hash").alias("hash"), F.lit(True).alias("_held")).join(waiting, ["book_id", "hash"], "left_semi")
        nth = F.row_number().over(Window.partitionBy("book_id", "hash").orderBy(F.concat_ws(":", F.col("book_id").cast("string"), F.col("chapter_index").cast("string"))))
        bodies = states.filter("hash is not null").select("book_id", "chapter_index", "hash", "waits").withColumn("_n", nth)
        found = bodies.join(held, ["book_id", "hash"], "left").filter("waits and (_n > 1 or _held)")
        return keep(found.select("book_id", "chapter_index", F.lit(True).alias("_again")))

    def take(self, incoming: DataFrame, batch: int) -> None:
        """Upserts chapters (book_id, chapter_index, title, canonical_url, body,
        position) of one batch by the rules of books.upsert_chapters, then accepts
        their bodies by those of books.accept_content: an accepted body makes its
        chapter done, a refused one leaves it as it is, with the code as its
        error. Rows without book, index or url are passed over. Bodies go no
        further than their hash; only what a url or a body forbids comes back to
        its chapter, and only rows that change are written."""
        body = F.col("body")
        new = incoming.filter("book_id is not null and chapter_index is not null and canonical_url is not null")
        new = keep(new.select("book_id", "chapter_index", "title", "canonical_url", "position", F.unhex(F.sha2(body, 256)).alias("hash"), (F.trim(body) == "").alias("empty"), F.monotonically_increasing_id().alias("row")), compression="zstd")
        states = self._states(new, batch)
        out = states.filter("changed or waits").join(self._repeated(states, batch), ["book_id", "chapter_index"], "left")
        good, refused = F.col("waits") & F.col("_again").isNull(), F.lit("chapter_content_duplicate")
        done = keep(out.filter(F.col("changed") | good | ~F.col("error").eqNullSafe(refused)).select(
            F.concat_ws(":", F.col("book_id").cast("string"), F.col("chapter_index").cast("string")).alias("id"), "book_id", "chapter_index", "title", "canonical_url", F.when(good, "done").otherwise(F.col("status")).alias("status"),
            F.lower(F.hex(F.when(good, F.col("hash")).otherwise(F.col("old_hash")))).alias("content_hash"), F.when(good, F.lit(None)).when(F.col("waits"), refused).otherwise(F.col("error")).alias("error"), "old_url", good.alias("good"),
        ), compression="zstd")
        moved = done.filter("old_url <> canonical_url").select("book_id", F.col("old_url").alias("canonical_url"))
        self.by_url.merge(done.filter("old_url is null or old_url <> canonical_url").select("book_id", "canonical_url", "chapter_index"), batch, moved)
        self.by_content.merge(done.filter("good").select("book_id", "content_hash", "chapter_index"), batch)
        self.by_index.merge(done.drop("old_url", "good"), batch)  # the last: what it has, the others have


def chapter_intake(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, buckets: int = 64):
    """Runs a stream of chapters (book_id, chapter_index, title, url, body,
    position) into a ChapterStore. Invalid urls are passed over."""
    store = ChapterStore(stream.sparkSession, path, buckets)
    named = stream.select("book_id", "chapter_index", "title", urls.canonical_url(F.col("url")).alias("canonical_url"), "body", "position")

    def write(batch, batch_id):
        store.take(batch, batch_id)

    return start(stream.sparkSession, named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})))


def run_gaps(gaps: DataFrame, target: str, checkpoint: str) -> None:
    """Runs request_gaps over what its stream holds now into a Parquet folder,
    each micro-batch under its number; progress is in the checkpoint folder."""

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    start(gaps.sparkSession, gaps.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)).awaitTermination()


def run_states(states: DataFrame) -> str:
    """Runs task_states (with `late`: the clock's timeouts never come to an end)
    over what its stream holds now; the folder of the rows by batch."""
    target, checkpoint = new_folder(states.sparkSession), new_folder(states.sparkSession)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    start(states.sparkSession, states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)).awaitTermination()
    return target


def last_states(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of each task."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    newest = F.max_by(F.struct("version", "status", "resume_status", "code"), "batch").alias("s")
    return rows.groupBy("task_id").agg(newest).select("task_id", "s.*")

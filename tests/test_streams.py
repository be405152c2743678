"""Streams that are stopped, repeated and late; claims; long pauses and short gaps."""

import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chapterlake.operators import events
from chapterlake.sources.tables import KeyedTable
from chapterlake.streaming import tasks

EVENTS = "task_id string, task_version long, to_status string, created_at timestamp"
AT = datetime(2024, 1, 1)


# --- live tasks ---------------------------------------------------------------


class Handle:
    """The states of one task, in memory."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return Cell()

    def getListState(self, name, schema):
        return Cell()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Cell:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def appendList(self, rows):
        self.value = [*(self.value or ()), *rows]

    def clear(self):
        self.value = None


class Times:
    def __init__(self, now=0):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now


def processor(**more):
    p = tasks.TaskProcessor(**({"wait_ms": 1000, "early": 0, "by_event": True} | more))
    handle = Handle()
    p.init(handle)
    return p, handle


def part(rows):
    return pd.DataFrame([(v, s, pd.Timestamp(AT)) for v, s in rows], columns=["task_version", "to_status", "created_at"])


def shown(p, rows, now=0):
    (out,) = p.handleInputRows(("t",), iter(rows), Times(now))
    return tuple(out.iloc[0][["version", "status", "resume_status", "code"]])


def test_a_million_events_of_one_task_in_one_batch():
    n, rng = 1_000_000, np.random.default_rng(0)
    names = np.array(["created", "probing", "validating"])
    order = rng.permutation(n)
    kind = np.where(order == 0, 0, np.where(order % 2 == 1, 1, 2))
    p, _ = processor()
    tracemalloc.start()
    out = shown(p, (pd.DataFrame({"task_version": order[k : k + 10_000], "to_status": names[kind[k : k + 10_000]], "created_at": pd.Timestamp(AT)}) for k in range(0, n, 10_000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out == (n - 1, "probing", None, None) and peak < 150e6


def test_early_events_wait_in_a_bounded_buffer():
    p, _ = processor(early=2)
    assert shown(p, [part([(2, "validating"), (0, "created")])]) == (0, "created", None, None)
    assert p.waiting.get() == [(2, "validating")]
    assert shown(p, [part([(1, "probing")])]) == (2, "validating", None, None) and not p.waiting.exists()
    assert shown(p, [part([(9, "ready"), (6, "ready"), (5, "ready")])])[3] == "version_conflict"
    assert p.waiting.get() == [(5, "ready"), (6, "ready")]


def test_timers_follow_the_last_wait():
    p, handle = processor()
    start = int(pd.Timestamp(AT).timestamp() * 1000)
    shown(p, [part([(0, "created"), (1, "probing"), (2, "waiting_for_user")])])
    assert handle.timers == {start + 1000}
    assert list(p.handleExpiredTimer(("t",), Times(), Times(start + 5))) == []  # not the timer that holds
    (out,) = p.handleExpiredTimer(("t",), Times(), Times(start + 1000))
    assert tuple(out.iloc[0][["version", "status", "resume_status", "code"]]) == (3, "recoverable_failed", "waiting_for_user", "wait_expired")
    assert shown(p, [part([(4, "validating")])])[:2] == (4, "validating")
    p, handle = processor()
    shown(p, [part([(0, "created"), (1, "probing"), (2, "waiting_for_user")])])
    shown(p, [part([(3, "validating")])])
    assert handle.timers == set()


def test_unknown_statuses_and_null_versions():
    p, _ = processor()
    assert shown(p, [part([(0, "created"), (None, "probing"), (1, "dancing")])]) == (0, "created", None, "illegal_transition")


def test_task_stream_that_is_stopped_between_batches(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    batches = [
        [("a", 0, "created", AT), ("a", 1, "probing", AT), ("b", 0, "created", AT), ("c", 0, "created", AT), ("c", 2, "validating", AT)],
        [("a", 2, "waiting_for_user", AT + timedelta(minutes=1)), ("b", 1, "completed", AT), ("c", 1, "probing", AT)],
        [("d", 0, "created", AT + timedelta(days=3))],  # moves the watermark past a's wait
    ]
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(source)
        states = tasks.task_states(spark.readStream.schema(EVENTS).parquet(source), "30 minutes", "1 day", early=3)
        write = lambda b, i: b.write.mode("overwrite").parquet(f"{target}/batch={i}")
        tasks.start(spark, states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)).awaitTermination(300)
    assert spark.conf.get("spark.sql.streaming.checkpoint.fileChecksum.enabled", "true") == "true"
    got = {r["task_id"]: (r["version"], r["status"], r["code"]) for r in tasks.last_states(spark, target).collect()}
    assert got == {"a": (3, "recoverable_failed", "wait_expired"), "b": (0, "created", "illegal_transition"), "c": (2, "validating", None), "d": (0, "created", None)}


# --- chapters -----------------------------------------------------------------

NEW = "book_id long, chapter_index long, title string, canonical_url string, body string, position long"


def taken(store):
    return sorted((r["book_id"], r["chapter_index"], r["canonical_url"], r["status"], r["error"]) for r in store.read().collect())


def test_chapters_of_repeated_and_broken_batches(spark, tmp_path, monkeypatch):
    rows = [(1, 1, "t", "u1", "one", 0), (1, 2, "t", "u2", "two", 1), (1, 3, "t", "u3", "one", 2), (1, 4, "t", "u1", "four", 3), (2, 1, "t", "u1", "one", 4), (1, 5, "t", "u5", " ", 5), (1, 6, "t", "u6", None, 6), (None, 1, "t", "u", "x", 7)]
    later = [(1, 3, "t", "u3b", "three", 0), (1, 7, "t", "u3", "seven", 1), (1, 1, "t", "u1", "one", 2), (1, 2, "t", "u2", "other", 3)]
    again = [(1, 8, "t", "u3", "eight", 0)]
    frames = [spark.createDataFrame(r, NEW) for r in (rows, later, again)]
    store = tasks.ChapterStore(spark, str(tmp_path / "a"), 4)
    store.take(frames[0], 0)
    first = [(1, 1, "u1", "done", None), (1, 2, "u2", "done", None), (1, 3, "u3", "pending", "chapter_content_duplicate"), (1, 5, "u5", "pending", "chapter_content_empty"), (1, 6, "u6", "pending", None), (2, 1, "u1", "done", None)]
    assert taken(store) == first
    store.take(frames[0], 0)  # the batch again, as after a failure
    assert taken(store) == first
    broken = KeyedTable.merge

    def fails(table, *args):
        if table is store.by_index:
            raise OSError("lost")
        return broken(table, *args)

    monkeypatch.setattr(KeyedTable, "merge", fails)
    with pytest.raises(OSError):
        store.take(frames[1], 1)
    monkeypatch.setattr(KeyedTable, "merge", broken)
    assert taken(store) == first
    store.take(frames[1], 1)
    # chapter 7 wanted a url that was bound when its batch came; it is free from the next one on
    assert (1, 3, "u3b", "done", None) in taken(store) and (1, 2, "u2", "done", "chapter_content_conflict") in taken(store) and not any(r[1] == 7 for r in taken(store))
    store.take(frames[2], 2)
    assert (1, 8, "u3", "done", None) in taken(store)
    whole = tasks.ChapterStore(spark, str(tmp_path / "b"), 4)
    for k, f in enumerate(frames):
        whole.take(f, k)
    assert taken(whole) == taken(store)


def test_a_batch_reads_and_writes_the_buckets_of_its_keys(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k long, v string", 16)
    frame = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k long, v string")
    table.merge(frame(range(200), "a"), 0)
    before = table.layout()
    one = frame([7], "b")
    assert len({f.rsplit("/", 2)[1] for f in table.near(one).inputFiles()}) == 1
    for n in (1, 2, 3):
        table.merge(one, n)
        assert sum(table.layout()[b] != before.get(b) for b in table.layout()) == 1
        assert len(list((tmp_path / "t" / "data" / f"batch={n}").glob("bucket=*"))) == 1
    table.merge(frame([300], "c"), 4, frame([8, 9], "x"))
    rows = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(rows) == 199 and rows[7] == "b" and rows[300] == "c" and 8 not in rows and 9 not in rows
    assert table.vacuum() >= 2 and {r["k"]: r["v"] for r in table.read().collect()} == rows
    (tmp_path / "t" / "log" / "batch=9").mkdir()  # a log that was never finished
    assert {r["k"]: r["v"] for r in table.read().collect()} == rows


def test_chapters_that_stay_as_they_are_are_not_written_again(spark, tmp_path):
    store = tasks.ChapterStore(spark, str(tmp_path / "d"), 2)
    frame = spark.createDataFrame([(1, 1, "t", "u1", "one", 0), (1, 2, "t", "u2", "one", 1), (1, 3, "t", "u3", None, 2), (1, 4, "t", "u4", " ", 3)], NEW)
    tables = (store.by_index, store.by_url, store.by_content)
    store.take(frame, 0)
    before, layouts = taken(store), [t.layout() for t in tables]
    store.take(frame, 1)
    assert taken(store) == before and [t.layout() for t in tables] == layouts and not (tmp_path / "d" / "index" / "data" / "batch=1").exists()


def test_chapters_of_a_batch_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Keys of many chapters pack into few bytes and would go through the driver whole."""
    store, plans, keep = tasks.ChapterStore(spark, str(tmp_path / "d"), 2), [], tasks.keep
    frame = spark.createDataFrame([(1, k, "t", f"u{k}", "one", k) for k in range(20)], NEW)

    def noted(df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, **options)

    monkeypatch.setattr(tasks, "keep", noted)
    for n in range(2):
        store.take(frame, n)
    assert len(plans) == 10 and not any("Broadcast" in p for p in plans)


def test_no_chapters(spark, tmp_path):
    store = tasks.ChapterStore(spark, str(tmp_path / "c"), 4)
    assert store.read().count() == 0
    store.take(spark.createDataFrame([], NEW), 0)
    assert store.read().count() == 0


# --- claims and pauses --------------------------------------------------------


def test_expired_claims_are_fenced(spark):
    at = lambda s: AT + timedelta(seconds=s)
    claims = spark.createDataFrame([(1, 1, "one", 1, "x", at(0), at(10)), (1, 1, "two", 2, "y", at(11), at(21))], "book_id long, chapter_index long, owner string, generation long, token string, at timestamp, expires_at timestamp")
    writes = [
        (1, 1, 1, at(5), "one", 1, "x", None), (1, 1, 2, at(12), "one", 1, "x", "stale_generation"), (1, 1, 3, at(12), None, None, None, "unclaimed_write"), (1, 1, 4, at(12), "two", 2, "y", None),
        (1, 1, 5, at(12), "two", 2, "z", "wrong_token"), (1, 1, 6, at(12), "one", 2, "y", "wrong_owner"), (1, 1, 7, at(21), "two", 2, "y", "expired_claim"), (1, 1, 8, at(30), None, None, None, None), (1, 2, 9, at(1), "one", 1, "x", "no_claim"), (1, 2, 10, at(1), None, None, None, None), (1, 1, 11, at(11), "two", 2, "y", None),
    ]
    got = events.fenced(claims, spark.createDataFrame([w[:7] for w in writes], "book_id long, chapter_index long, write_id long, at timestamp, owner string, generation long, token string"))
    assert {r["write_id"]: r["code"] for r in got.collect()} == {w[2]: w[7] for w in writes}


REQUESTS, INTERVALS = "host string, ts timestamp, id long", "host string, since timestamp, min_seconds double, pause_seconds double"


def requests_of(spark):
    at = lambda m: AT + timedelta(minutes=m)
    rows = [("h", at(m), m) for m in (0, 1, 3, 13, 24, 25, 42, 43)] + [("free", at(0), 1), ("late", at(0), 1), ("late", at(5), 2)]
    settings = [("h", at(0), 90.0, 600.0), ("h", at(25), 30.0, 960.0), ("late", at(4), 60.0, 60.0)]
    return spark.createDataFrame(rows, REQUESTS), spark.createDataFrame(settings, INTERVALS)


def test_visits_pauses_and_intervals_of_a_host(spark):
    requests, intervals = requests_of(spark)
    minute = lambda t: (t - AT).total_seconds() / 60
    visited = events.visits(requests, intervals)
    # a pause of exactly the limit (3 to 13) does not part two visits; the limit grows at minute 25
    assert sorted((r["host"], minute(r["first"]), minute(r["last"]), r["requests"]) for r in visited.collect()) == [("h", 0, 13, 4), ("h", 24, 25, 2), ("h", 42, 43, 2), ("late", 5, 5, 1)]
    assert sorted((r["host"], r["pause_us"] / 6e7) for r in events.pauses(visited).collect()) == [("h", 11), ("h", 17)]
    assert {r["id"] for r in events.impolite(requests, intervals).collect()} == {1}


def test_visits_of_a_stream(spark, tmp_path):
    requests, intervals = requests_of(spark)
    requests.unionByName(spark.createDataFrame([("h", AT + timedelta(days=9), 99)], REQUESTS)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    out = events.visits(stream, intervals.cache()).writeStream.outputMode("append").format("memory").queryName("visits").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    tasks.start(spark, out).awaitTermination(300)
    assert sorted(r["requests"] for r in spark.table("visits").filter("host = 'h' and requests > 1").collect()) == [2, 2, 4]


# --- gaps ---------------------------------------------------------------------


def audited(requests):
    """Brute force over (us, id, least, pause) of one host: (id, gap, code)."""
    out, last, timed, reach = [], None, None, None
    for us, number, least, pause in sorted(requests):
        if last is not None and us - last < least:
            out.append((number, us - last, "too_soon"))
        if pause >= 0:
            if reach is not None and us > reach:
                out.append((number, us - timed, "long_pause"))
            timed, reach = us, us + pause if reach is None else max(reach, us + pause)
        last = us
    return sorted(out)


@pytest.mark.parametrize("seed", range(5))
def test_gaps_of_a_host_in_any_batches(seed):
    rng = np.random.default_rng(seed)
    n, late = 300, 400
    us = 10**6 + np.sort(rng.integers(0, 40, n)).cumsum() * 100  # ties, and times within one millisecond
    rows = [(int(t), int(k), int(rng.integers(-1, 2000)), int(rng.choice([-1, 500, 3000]))) for t, k in zip(us, rng.permutation(n))]
    p, handle = tasks.GapProcessor(), Handle()
    p.init(handle)
    arrival, found, watermark = sorted(range(n), key=lambda k: us[k] + int(rng.integers(0, late * 1000 // 2))), [], 0
    for cut in np.array_split(arrival, 7) + [[]]:
        came = pd.DataFrame([rows[k] for k in cut], columns=["us", "id", "least", "pause"])
        if len(came):
            list(p.handleInputRows(("h",), iter([came[:9], came[9:]] if len(came) > 9 else [came]), Times(watermark)))
            watermark = max(watermark, int(came["us"].max()) // 1000 - late)
        else:
            watermark = int(us.max()) // 1000 + 1
        assert len(handle.timers) <= 1
        for at in [t for t in handle.timers if t <= watermark]:
            handle.timers.discard(at)
            expired = Times(watermark)
            expired.getExpiryTimeInMs = lambda at=at: at
            for out in p.handleExpiredTimer(("h",), Times(watermark), expired):
                found += out[["id", "gap_us", "code"]].itertuples(index=False, name=None)
    assert sorted(found) == audited(rows) and {c for *_, c in found} == {"too_soon", "long_pause"} and not p.held.exists()


def test_gaps_of_a_stream_that_is_stopped_between_batches(spark, tmp_path):
    requests, intervals = requests_of(spark)
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    extra = spark.createDataFrame([(None, AT, 1), ("h", None, 2), ("h", AT, None)], REQUESTS)
    closing = spark.createDataFrame([("z", AT + timedelta(days=9), 99)], REQUESTS)
    # minute 3 comes a batch after minute 13, minute 24 after 25
    batches = [requests.filter("id in (0, 1, 13)").unionByName(extra), requests.filter("id in (2, 3, 25) or host = 'free'"), requests.filter("id in (24, 42, 43)").unionByName(closing)]
    for rows in batches:
        rows.write.mode("append").parquet(source)
        tasks.run_gaps(tasks.request_gaps(spark.readStream.schema(REQUESTS).parquet(source), intervals, "1 hour"), target, checkpoint)
    got = sorted((r["host"], r["id"], r["gap_us"] / 6e7, r["code"]) for r in spark.read.parquet(target).collect())
    assert got == [("h", 1, 1, "too_soon"), ("h", 24, 11, "long_pause"), ("h", 42, 17, "long_pause")]


def test_a_busy_host_is_dealt_by_spans(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 11 == 0 else "hot" if k % 3 else f"h{k % 7}", None if k % 50 == 0 else AT + timedelta(minutes=int(rng.integers(-4000, 4000))), k) for k in range(600)]
    rows += rows[:5]
    requests = spark.createDataFrame([(*r, "x") for r in rows], REQUESTS + ", gap string")
    wanted, last = [], {}
    for host, ts, number in sorted(rows, key=lambda r: (r[0] or "", r[1] or datetime.min, r[2])):
        before = last.get(host)
        wanted.append((host, number, None if ts is None or before is None else round((ts - before).total_seconds() * 1e6)))
        last[host] = ts
    found = events.gaps(requests, 2)
    assert found.columns == [*requests.columns, "gap_us"]
    assert sorted(map(repr, ((r["host"], r["id"], r["gap_us"]) for r in found.collect()))) == sorted(map(repr, wanted))
    assert events.gaps(requests.limit(0)).count() == 0

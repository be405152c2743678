"""Pages dealt for parsing, the reader of plain pages, references in titles,
captures that repeat."""

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import test_streams as streams
from chapterlake.operators import dedup, dom, pages
from chapterlake.plans import site_queries
from chapterlake.sources import readers
from chapterlake.streaming import tasks


def test_pages_of_a_grouping_are_parsed_in_parts(spark):
    """Rows that are already parted by page are few bytes: one task would parse all."""
    lines = spark.range(4000).select((F.col("id") % 1000).alias("l_orderkey"), F.floor(F.col("id") / 1000).alias("n"))
    grouped = lines.groupBy("l_orderkey").agg(F.max("n").alias("n"))
    made = site_queries._dealt(spark, grouped.select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit("<p>"), F.col("n").cast("string")).alias("html")))
    nodes = site_queries._nodes(made)
    assert len(nodes.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions")) and nodes.count() == 1000
    assert dom.paths(nodes).select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_plain_pages_are_read_as_the_parser_reads_them(monkeypatch):
    rng = random.Random(3)
    parts = '<p> </p> <li> <ul> </ul> <table> <tr> <td> </td> </table> <h1> </h1> <b|class="x|y"> </b> <title> </title> <script> </script> t&amp; &lt|x <br> <br|/> <dd> <dt> <a|href="/1"> </a> <head> </head> <body> <div/> <textarea> <img|src="a&b"> <!--c--> é | &'.split()
    texts = ["".join(rng.choice(parts).replace("|", " ") for _ in range(rng.randrange(1, 20))) for _ in range(4000)] + [None, "", "<!DOCTYPE html> a<p>b&amp", "<p>x</p><"]

    def read():
        flat = pages._Flat()
        for k, html in enumerate(texts):
            flat.page(k, html)
        return flat.columns

    plain = read()
    monkeypatch.setattr(pages._Flat, "_plain", lambda self, html: False)
    monkeypatch.setattr(pages._Flat, "feed", lambda self, html, feed=pages._Flat.feed: feed(self, html or ""))
    assert plain == read()


def test_some_nodes_have_paths(spark):
    nodes = pages.flatten(spark.createDataFrame([(1, "<ul><li>a<li>b</ul>"), (2, "<p>c"), (3, "<ul><li>d</ul>")], "page_id long, html string")).cache()
    asked = spark.createDataFrame([(1, 2), (1, 2), (1, 9), (3, 1), (4, 0)], "page_id long, node_id int")
    got = {(r["page_id"], r["node_id"]): r["selector"] for r in dom.paths(nodes, asked).collect()}
    assert got == {(1, 2): "li:nth-of-type(2)", (3, 1): "li"} and dom.paths(nodes, asked).count() == 2


@pytest.mark.parametrize("name", ["page_facts", "title_selectors", "book_infos"])
def test_titles_cut_in_a_reference(spark, tmp_path, name):
    """Texts cut behind `&amp`: SQL and query read the reference alike."""
    said = ["a &amp; b &amp", "c &amp;&amp", "&quot;d&quot; &lt;e&gt", "&amp;lt; f &am", ""]
    rows = [(k, f"http://h.test/{k}", f"<html><head><title>{t}</title></head><body><article><h1>{t}</h1></article></body></html>") for k, t in enumerate(said)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    found = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
    columns = ", ".join(f'"{c}"' for c in found.columns)
    assert sorted(map(repr, con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall())) == sorted(repr(tuple(r)) for r in found.collect())


def test_earliest_capture_is_taken(spark, tmp_path):
    """Of captures of one URL that come together the earliest counts, then the
    least id; later ones within a day are not taken again."""
    shape, day = "page_id long, url string, html string, retrieved_at timestamp", datetime(2024, 1, 1)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def take(*rows):
        spark.createDataFrame(list(rows), shape).coalesce(1).write.mode("append").parquet(folder)
        tasks.intake(spark.readStream.schema(shape).parquet(folder), out, str(tmp_path / "ck"), buckets=2).awaitTermination(120)
        return {(r["page_id"], r["canonical_url"]) for r in spark.read.parquet(out).collect()}

    first = take((9, "http://h.test/a", "nine", day), (1, "http://h.test/a#x", "one", day), (2, "http://h.test/b", "two", day + timedelta(hours=1)), (3, "http://h.test/b", "three", day))
    assert first == {(1, "http://h.test/a"), (3, "http://h.test/b")}
    assert take((4, "http://h.test/a", "four", day + timedelta(hours=2)), (5, "http://h.test/b", "five", day + timedelta(days=2))) == first | {(5, "http://h.test/b")}


def test_pairs_of_parted_books(spark, monkeypatch):
    """Books of several blocks, rare and common members, texts of one character
    and beyond the first plane: pairs equal brute force, however books are parted."""
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh😀😁") for _ in range(80)) for _ in range(4)]
    rows = [(7, 900, "x"), (7, 901, "x"), (7, 902, "xx"), (8, 903, None), (8, 904, "")]
    for k in range(150):
        body = list(base[k % 4])
        for _ in range(rng.randint(0, 4)):
            body[rng.randrange(80)] = rng.choice("abxyz😀")
        rows.append((7 + k % 3 // 2, k, "".join(body)))
    least = {}
    for b, k, t in sorted(rows, key=lambda r: r[1]):
        if t:
            least.setdefault((b, t), k)
    items = [(b, k, {t[j : j + 2] for j in range(len(t) - 1)} or {t}) for (b, t), k in least.items()]
    want = {(b, i, j): len(g & h) / len(g | h) for b, i, g in items for c, j, h in items if b == c and i < j and len(g & h) / len(g | h) >= 0.85}
    chapters = spark.createDataFrame(rows, "book_id int, chapter_index long, body string")
    for name, value in (("HOT", 8), ("DENSE", 4), ("FEW", 3), ("WIDE", 3)):
        monkeypatch.setattr(dedup, name, value)
    found = dedup.similar_pairs(chapters)
    rows = found.collect()
    assert {(r["book_id"], r["a"], r["b"]): r["score"] for r in rows} == want and len(rows) == len(want) > 100
    got = [(r["book_id"], r["a"], r["b"]) for r in dedup.approximate_pairs(chapters).collect()]
    assert len(set(got)) == len(got) >= 0.95 * len(want) and set(got) <= set(want)
    placed = found._jdf.queryExecution().toString()
    assert "array_intersect" not in placed  # sets meet in blocks, not shipped a pair


def test_counts_of_shared_members(monkeypatch):
    """By products of matrices and pair by pair alike."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(-3, 60, 20)) for _ in range(40)]
    left, right = sets[:25], sets[25:]
    want = [[len(np.intersect1d(x, y)) for y in right] for x in left]
    for dense, few, wide in ((4096, 50_000, 2048), (0, 10**6, 2048), (5, 60, 4)):
        for name, value in (("DENSE", dense), ("FEW", few), ("WIDE", wide)):
            monkeypatch.setattr(dedup, name, value)
        assert dedup._shared(left, right, [(0, 25, 0, 15)]).tolist() == want


@pytest.mark.parametrize("early", [0, 2])
def test_buckets_of_tasks_move_as_each_task(early):
    """Many tasks in one value with one timer: rows of every batch are those of
    a processor a task, with early events, nulls, unknown statuses and waits."""
    rng = random.Random(early)
    at = datetime(2024, 1, 1)
    path = ["created", "probing", "waiting_for_user", "probing", "validating", "dancing", "paused"]
    settings = {"wait_ms": 60_000, "early": early, "by_event": True}
    alone, handles = {}, {}
    many, handle = tasks.TaskBuckets(**settings), streams.Handle()
    many.init(handle)
    seen, onward = set(), [0] * 30
    ms = lambda t: int(t.timestamp() * 1000 - datetime(2024, 1, 1).timestamp() * 1000) + 1_704_067_200_000
    for batch in range(12):
        rows = []
        for k in range(30):
            for _ in range(rng.randint(0, 2) * (batch < 6 or k % 3 == 0)):
                version, status = onward[k], path[min(onward[k], 6)]
                onward[k] += 1
                strange = rng.random()
                if strange < 0.1:
                    version, status = (None if strange < 0.03 else version + rng.randint(-1, 2)), rng.choice(path)
                rows.append((None if k == 0 else str(k), version, status, at + timedelta(seconds=20 * batch + rng.randint(0, 9))))
        rng.shuffle(rows)
        frame = pd.DataFrame(rows, columns=["task_id", "task_version", "to_status", "created_at"])
        now = streams.Times(ms(at) + 20_000 * batch)
        want = []
        for k in dict.fromkeys(frame["task_id"]):
            if k not in alone:
                alone[k], handles[k] = tasks.TaskProcessor(**settings), streams.Handle()
                alone[k].init(handles[k])
            mine = frame[frame["task_id"].isna() if k is None else frame["task_id"] == k]
            want += [out for out in alone[k].handleInputRows((k,), iter([mine[:1], mine[1:]] if len(mine) > 1 else [mine]), now)]
        got = [*many.handleInputRows((0,), iter([frame[:20], frame[20:]]), now)]
        for timers, p, key, out in [*((handles[k].timers, alone[k], k, want) for k in alone), (handle.timers, many, 0, got)]:
            assert len(timers) <= 1
            for due in [t for t in timers if t < now.now]:
                timers.discard(due)
                out += p.handleExpiredTimer((key,), now, streams.Times(due))
        plain = lambda frames: sorted(repr([None if x != x else x for x in r]) for f in frames for r in f[["task_id", "version", "status", "resume_status", "code"]].astype(object).itertuples(index=False))
        assert plain(got) == plain(want)
        seen |= {c for f in got for c in f["code"]}
    assert {"version_conflict", "illegal_transition", "wait_expired", None} <= seen


def test_a_batch_calls_for_a_bucket_once(spark):
    """Not for the state of each of its tasks."""
    stream = spark.readStream.format("rate").load().selectExpr("value AS task_id", "value AS task_version", "'created' AS to_status", "timestamp AS created_at")
    found = tasks.task_states(stream, late="1 day", buckets=16)
    assert found.schema["task_id"].dataType.simpleString() == "bigint" and "xxhash64" in found._jdf.queryExecution().toString()


def test_pages_are_laid_out_in_one_pass(spark):
    """Selectors, noise and totals of whole pages equal those of the windows
    and joins, nested noise and pages without marks among them, in one shuffle."""
    rng = random.Random(4)
    parts = '<div|class="chapter"> <div|class="ad|box"> </div> <ul|id="list"> <li> </ul> <a|href="/1">第1章</a> <p> text more <b> </b> <div|id="comment-1"> <br>'.split()
    html = [(k, "".join(rng.choice(parts).replace("|", " ") for _ in range(rng.randrange(0, 40)))) for k in range(120)]
    nodes = pages.flatten(spark.createDataFrame(html, "page_id long, html string")).cache()
    good = nodes.filter("tag = 'a' and page_id % 3 > 0").select("page_id", "node_id")
    shown, para = F.length("own_text"), F.col("tag") == "p"
    found = dom.laid_out(nodes, dom.is_noise(), good, {"chars": shown}, {"clean_chars": shown, "paragraphs": para})
    flagged = dom.covered(dom.paths(nodes), nodes.filter(dom.is_noise()), "noise").join(good.withColumn("_g", F.lit(1)), ["page_id", "node_id"], "left")
    want = dom.subtree_totals(flagged, chars=shown, clean_chars=F.when(~F.col("noise"), shown).otherwise(0), paragraphs=para & ~F.col("noise"), marks=F.coalesce("_g", F.lit(0)))
    columns = ["page_id", "node_id", "selector", "noise", "chars", "clean_chars", "paragraphs", "marks", "own_text"]
    rows = [sorted(map(tuple, df.select(*columns).collect())) for df in (found, want)]
    assert rows[0] == rows[1] and len(rows[0]) > 500 and {True, False} == {r[3] for r in rows[0]}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_decoded_in_portions(spark, monkeypatch):
    """Long bodies of one batch do not lie decoded side by side; rows stay."""
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * n if n is not None else None for n in (3, None, 9, 0, 4, 4, 30)], pa.binary())], ["body"])
    monkeypatch.setattr(readers, "PORTION", 8)
    parts = list(readers._portions(batch))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert [p.num_rows for p in parts] == [3, 2, 2] and list(readers._portions(batch.slice(0, 0))) == []
    said = [None if k == 3 else "é第一章 " * (k % 40) + "x" for k in range(200)]
    raw = spark.createDataFrame([(k, None if t is None else bytearray(t.encode("utf-16-be")), "text/html; charset=UTF-16-BE") for k, t in enumerate(said)], "page_id long, body binary, content_type string").coalesce(1)
    assert [r["html"] for r in readers.decode_pages(raw).orderBy("page_id").collect()] == said


def test_buckets_of_hosts_are_judged_as_each_host():
    """Many hosts in one state with one timer, rows in any batches."""
    rng = np.random.default_rng(8)
    rows = [(f"h{k % 9}", int(us), k, int(rng.integers(-1, 2000)), int(rng.choice([-1, 500, 3000]))) for k, us in enumerate(10**6 + rng.integers(0, 4000, 400).cumsum())]
    want = sorted((h, *r) for h in {r[0] for r in rows} for r in streams.audited([r[1:] for r in rows if r[0] == h]))
    p, handle = tasks.GapBuckets(), streams.Handle()
    p.init(handle)
    late, watermark, found = 400, 0, []
    for cut in [*np.array_split(sorted(range(400), key=lambda k: rows[k][1] + int(rng.integers(0, late * 500))), 6), []]:
        came = pd.DataFrame([rows[k] for k in cut], columns=["host", "us", "id", "least", "pause"])
        if len(came):
            assert list(p.handleInputRows((0,), iter([came[:9], came[9:]]), streams.Times(watermark))) == []
        watermark = max(watermark, int(came["us"].max()) // 1000 - late) if len(came) else rows[-1][1] // 1000 + 1
        assert len(handle.timers) <= 1
        for due in [t for t in handle.timers if t <= watermark]:
            handle.timers.discard(due)
            for out in p.handleExpiredTimer((0,), streams.Times(watermark), streams.Times(due)):
                found += out[["host", "id", "gap_us", "code"]].itertuples(index=False, name=None)
    assert sorted(found) == want and len(want) > 50 and not handle.timers

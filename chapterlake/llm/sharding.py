"""Sharding by sampled splitters: shards of near equal bytes.

Each row has a size and a key (a hash of its text, so that equal texts lie
together). A sample of keys, drawn with chances in proportion to size, gives
quantile boundaries; rows are range-partitioned by them, and ranges that hold
too many bytes are subdivided by samples of their own. From the exact bytes of
the ranges before it and a running sum within its range, each row then knows
its place in the whole order, and the shard is the sixteenth (say) of all
bytes that the middle of its group of equal texts falls into. Such a group
lies whole in one range and one shard, unless it holds more than TOGETHER of a
shard's bytes: then it is parted by id, and rows alike in that too by a row
number.

Everything is DataFrame functions. Null text has size 1 and lies with the
empty texts; null ids sort first; rows that repeat exactly take places in any
order; an empty table gives no rows. Only sizes, checksums and hashes of texts
are shuffled, so texts may be of any length. Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Sampled keys a range, and how far above the mean a range may hold.
SAMPLES_PER_RANGE, OVERFULL = 16, 3.0
#: Rows of one key go together up to this share of a shard.
TOGETHER = 0.05
#: Ranges at least, and bytes of text that one range holds where that makes
#: more; parts of an overfull range; least bits of the key by which boundaries
#: are met.
RANGES, RANGE_BYTES, PARTS, LEVELS = 512, 1 << 32, 8, 10
#: Where a key's rows begin: before every id and row number.
_FIRST = (-(1 << 63), -1)


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _place() -> list[Column]:
    return [F.col("key"), F.coalesce("id", F.lit(_FIRST[0])).alias("id"), F.col("row")]


def splitters(rows: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """(key, id, row) boundaries in each range_id of rows: quantiles of a
    size-weighted sample without replacement (least exponential waiting times,
    from hashes). At most ranges * SAMPLES_PER_RANGE rows a range are gathered."""
    unit = (F.pmod(F.xxhash64("key", "id", "row"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    least = Window.partitionBy("range_id").orderBy("wait", "key", "id", "row")
    waiting = rows.select("range_id", *_place(), (-F.log(unit) / F.col("size")).alias("wait"))
    sample = waiting.withColumn("nth", F.row_number().over(least)).filter(F.col("nth") <= ranges * SAMPLES_PER_RANGE)
    by_range: dict[int, list] = {}
    for r in sample.select("range_id", "key", "id", "row").collect():  # bounded
        by_range.setdefault(r["range_id"], []).append((r["key"], r["id"], r["row"]))
    return sorted({sorted(got)[k * len(got) // ranges] for got in by_range.values() for k in range(1, ranges)})


def first_splitters(rows: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """The boundaries of the whole table, whose sample is ordered by all tasks."""
    unit = (F.pmod(F.xxhash64("key", "id", "row"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    sample = rows.select(*_place(), (-F.log(unit) / F.col("size")).alias("wait")).orderBy("wait", "key", "id", "row").limit(ranges * SAMPLES_PER_RANGE)
    got = sorted((r["key"], r["id"], r["row"]) for r in sample.select("key", "id", "row").collect())  # bounded
    return sorted({got[k * len(got) // ranges] for k in range(1, ranges)}) if got else []


def keep_together(rows: DataFrame, bounds: list[tuple[int, int, int]], most: float) -> list[tuple[int, int, int]]:
    """Boundaries inside a key of at most `most` bytes move to its beginning."""
    spark = rows.sparkSession
    keys = F.broadcast(spark.createDataFrame([(k,) for k in sorted({b[0] for b in bounds})], "key long"))  # no more than there are boundaries
    large = {r["key"] for r in rows.join(keys, "key").groupBy("key").agg(F.sum("size").alias("n")).filter(F.col("n") > most).select("key").collect()}
    return sorted({b if b[0] in large else (b[0], *_FIRST) for b in bounds})


def with_range(spark: SparkSession, rows: DataFrame, bounds: list[tuple[int, int, int]], bits: int) -> DataFrame:
    """Adds range_id. Boundaries are met by the leading bits of the key, so a
    row is compared with the few that share them."""
    edges = [(-1, *_FIRST), *bounds, (1 << 60, *_FIRST)]
    table = []
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        first, last = max(lo[0], 0) >> bits, min(hi[0], (1 << 60) - 1) >> bits
        table += [(slot, k, lo, hi) for slot in range(first, last + 1)]
    place = "struct<key:long,id:long,row:long>"
    known = F.broadcast(spark.createDataFrame(table, f"slot long, range_id long, lo {place}, hi {place}"))  # fewer rows than ranges and slots
    own = F.struct(*_place())
    joined = rows.withColumn("slot", F.shiftright("key", bits)).join(known, "slot")
    return joined.filter((own >= F.col("lo")) & (own < F.col("hi"))).drop("slot", "lo", "hi")


def shard_by_bytes(docs: DataFrame, shards: int, ranges: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, shard, slot. ranges: by
    default as many as the bytes ask for, so that a task's rows do not grow
    with the table."""
    spark = docs.sparkSession
    rows = common.stage(
        docs.select(
            F.col("doc_id").cast("long").alias("id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("check"),
            text_key(F.col("text")).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard_rows",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    ranges = ranges or max(RANGES, -(-total // RANGE_BYTES))
    bits = 60 - max(LEVELS, ranges.bit_length())
    together = TOGETHER * total / shards
    bounds = keep_together(rows, first_splitters(rows, ranges), together)
    while True:  # overfull ranges are parted by samples of their own, until no part is new
        parted = with_range(spark, rows, bounds, bits)
        full = parted.groupBy("range_id").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("m")).filter((F.col("n") > OVERFULL * total / ranges) & (F.col("m") > 1))
        more = splitters(parted.join(F.broadcast(full.select("range_id")), "range_id", "left_semi"), PARTS)  # fewer ids than ranges
        following = keep_together(rows, [*bounds, *more], together) if more else bounds
        if following == bounds:
            break
        bounds = following
    parted = with_range(spark, rows, bounds, bits)
    sums = parted.groupBy("range_id").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("m"))
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    firsts = F.broadcast(sums.select("range_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("rows_before")))
    inside = Window.partitionBy("range_id").orderBy(F.col("key").asc(), F.col("id").asc_nulls_first(), F.col("row").asc())
    peers = Window.partitionBy("range_id", "key")
    placed = (
        parted.join(firsts, "range_id")
        .withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("bytes_before"))
        .withColumn("nth", F.row_number().over(inside) - 1 + F.col("rows_before"))
        .withColumn("of_key", F.sum("size").over(peers))
        .withColumn("first_of_key", F.min("before").over(peers))
        .withColumn("middle", F.when(F.col("of_key") <= together, F.col("first_of_key") * 2 + F.col("of_key")).otherwise(F.col("before") * 2 + F.col("size")))
        .withColumn("shard", F.least(F.expr(f"middle * {shards} div {max(2 * total, 1)}"), F.lit(shards - 1)).cast("int"))
        .select("id", "size", "check", "shard", "nth")
    )
    placed = common.stage(placed, "placed")
    common.release(rows)
    starts = F.broadcast(placed.groupBy("shard").agg(F.min("nth").alias("start")))
    return placed.join(starts, "shard").select(F.col("id").alias("doc_id"), "size", F.col("check").alias("text_crc32"), "shard", (F.col("nth") - F.col("start")).alias("slot"))

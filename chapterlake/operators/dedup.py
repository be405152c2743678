"""Exact and near duplicates among the chapters of a book."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import keep


def exact_duplicates(chapters: DataFrame) -> DataFrame:
    """Chapters whose body an earlier one of the book has: book_id, first_index,
    chapter_index. Null bodies take no part. The first index comes from a
    pre-aggregated minimum, so a body that fills a book shuffles once a task."""
    hashed = chapters.filter(F.col("body").isNotNull()).select("book_id", "chapter_index", F.md5(F.col("body").cast("binary")).alias("h"))
    firsts = hashed.groupBy("book_id", "h").agg(F.min("chapter_index").alias("first_index"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return hashed.join(firsts, ["book_id", "h"]).filter("chapter_index > first_index").select("book_id", "first_index", "chapter_index")


#: A group of over HOT bodies is parted into blocks of about so many.
HOT = 4096
#: Columns of a product at once; columns that are always multiplied; a column of
#: at most so many pairs is counted pair by pair beyond these.
WIDE, DENSE, FEW = 2048, 4096, 50_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bigrams(body: str) -> np.ndarray:
    """The distinct pairs of neighbouring code points as sorted numbers; a single
    one is its own."""
    points = np.frombuffer(body.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique((points[:-1] << 21) | points[1:]) if len(points) > 1 else -1 - points


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.diff(values, prepend=0).astype("<i8").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<i8"))


def _sets(chapters: DataFrame, bands: int = 0, rows: int = 0) -> DataFrame:
    """(book_id, i, n, g, bands): the packed bigram set of each distinct body of
    a book and its size, by the least index that has it, and a hash of the
    `rows` least hashes of each of `bands` bands."""
    distinct = chapters.filter(F.length("body") > 0).groupBy("book_id", "body").agg(F.min("chapter_index").alias("i")).select("book_id", "i", "body")
    seeds = _mixed(np.arange(bands * rows, dtype=np.uint64))[:, None]

    def run(batches):
        for batch in batches:
            sizes, packed, signed = [], [], []
            for body in batch.column(2).to_pylist():
                values = _bigrams(body)
                sizes.append(len(values))
                packed.append(_packed(values))
                least = _mixed(values.astype(np.uint64)[None, :] ^ seeds).min(axis=1, initial=np.uint64(2**64 - 1)).reshape(bands, rows) if bands else np.zeros((0, 0), np.uint64)
                hashed = np.zeros(bands, np.uint64)
                for r in range(rows):
                    hashed = _mixed(hashed ^ least[:, r])
                signed.append(hashed.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), pa.array(signed, pa.list_(pa.int64()))], ["book_id", "i", "n", "g", "bands"])

    kinds = [distinct.schema[c].dataType.simpleString() for c in ("book_id", "i")]
    parts = int(chapters.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer: few bytes are much work
    return keep(distinct.repartition(parts, F.xxhash64("book_id", "i")).mapInArrow(run, f"book_id {kinds[0]}, i {kinds[1]}, n long, g binary, bands array<long>"))


def _shared(left: list[np.ndarray], right: list[np.ndarray], spans: list[tuple[int, int, int, int]]) -> np.ndarray:
    """How many members each set of `left` shares with each of `right`, for the
    given spans of rows (from, to) and columns (from, to). Members of many sets
    are counted by products of matrices, the others pair by pair."""
    rows, columns = len(left), len(right)
    sizes = np.array([len(x) for x in (*left, *right)])
    members, place = np.unique(np.concatenate((*left, *right)), return_inverse=True)
    owner, many = np.repeat(np.arange(rows + columns), sizes), len(members)
    mine = owner < rows
    a, b = np.bincount(place[mine], minlength=many), np.bincount(place[~mine], minlength=many)
    pairs = a * b
    order = np.argsort(-pairs, kind="stable")
    dense = order[: max(min(DENSE, np.count_nonzero(pairs)), np.count_nonzero(pairs > FEW))]
    column = np.full(many, -1)
    column[dense] = np.arange(len(dense))
    out = np.zeros((rows, columns), np.float32)
    at = column[place]
    for lo in range(0, len(dense), WIDE):
        inside = (at >= lo) & (at < lo + WIDE)
        both = np.zeros((rows + columns, min(WIDE, len(dense) - lo)), np.float32)
        both[owner[inside], at[inside] - lo] = 1
        for r0, r1, c0, c1 in spans:
            out[r0:r1, c0:c1] += both[r0:r1] @ both[rows + c0 : rows + c1].T
    if len(dense) < np.count_nonzero(pairs):
        rare = (column < 0) & (pairs > 0)
        x, y = np.flatnonzero(mine & rare[place]), np.flatnonzero(~mine & rare[place])
        y = y[np.argsort(place[y], kind="stable")]
        begins = np.cumsum(np.where(rare, b, 0)) - np.where(rare, b, 0)
        for lo in range(0, len(x), 1 << 14):  # at most FEW pairs a member
            some = x[lo : lo + (1 << 14)]
            each = b[place[some]]
            met = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begins[place[some]], each)
            np.add.at(out, (np.repeat(owner[some], each), owner[y[met]] - rows), 1)
    return out


def _linked(sets: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(book_id, a, b, score) of the similar pairs within groups (book_id, band,
    value, i, n; written) of sets. A pair that meets in several bands is given by the first.

    A group of over HOT bodies is parted by size into blocks, and only blocks
    near enough in size meet. A task holds the sets of two blocks, and a group's
    blocks are dealt over all tasks."""
    t, key = threshold, ["book_id", "band", "value"]
    inner = Window.partitionBy(*key)
    sized = groups.groupBy(*key, "n").agg(F.count(F.lit(1)).alias("_c")).withColumn("_all", F.sum("_c").over(inner)).filter("_all > 1")
    sized = sized.withColumn("_before", F.sum("_c").over(inner.orderBy("n")) - F.col("_c"))
    block = F.floor((F.col("_before") + F.pmod(F.xxhash64("i"), F.col("_c"))) / HOT).cast("int")
    placed = keep(groups.join(sized, [*key, "n"]).select(*key, "i", "n", block.alias("block")))
    blocks = placed.groupBy(*key, "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = blocks.select(*key, F.col("block").alias("x"), "hi"), blocks.select(*key, F.col("block").alias("y"), "lo")
    near = keep(x.join(y, key).filter(f"x <= y and hi >= {t} * lo - 1e-9").select(*key, "x", "y"))
    side = lambda pairs, name, second: placed.join(pairs.withColumn("block", F.col(name)), [*key, "block"]).select(*key, "x", "y", "i", F.lit(second).alias("second"))
    dealt = side(near, "x", False).unionByName(side(near.filter("x < y"), "y", True)).join(sets, ["book_id", "i"])
    job = F.concat_ws("|", "band", "value", "x", "y", F.col("book_id").cast("string"))
    dealt = dealt.select("book_id", "i", "n", "g", "bands", "band", "second", job.alias("job"))
    schema = dealt.sparkSession.createDataFrame([], dealt.schema).select("book_id", F.col("i").alias("a"), F.col("i").alias("b")).schema
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)

    def met(rows: pa.Table):
        band, sizes = rows.column("band")[0].as_py(), rows.column("n").to_numpy()
        second = rows.column("second").to_numpy(zero_copy_only=False)
        whole = [np.flatnonzero(~second), np.flatnonzero(second)]
        left, right = [k[np.argsort(sizes[k], kind="stable")] for k in (whole if second.any() else whole[:1] * 2)]
        n, m = sizes[left], sizes[right]
        ends = [(lo, min(lo + 512, len(left))) for lo in range(0, len(left), 512)]
        spans = [(lo, hi, int(np.searchsorted(m, t * n[lo] - 1e-9)), int(np.searchsorted(m, n[hi - 1] / t + 1e-9, "right"))) for lo, hi in ends]
        packed = [_unpacked(g) for g in rows.column("g").to_pylist()]
        both = _shared([packed[k] for k in left], [packed[k] for k in right], spans)
        signs = np.array(rows.column("bands").to_pylist(), np.int64).reshape(len(sizes), -1)
        for lo, hi, c0, c1 in spans:
            part = both[lo:hi, c0:c1].astype(np.float64)
            score = part / (n[lo:hi, None] + m[None, c0:c1] - part)
            r, c = np.nonzero(score >= t)
            score, r, c = score[r, c], left[lo + r], right[c0 + c]
            good = np.ones(len(r), bool) if second.any() else r < c
            if band >= 0:
                good &= (signs[r] == signs[c]).argmax(axis=1) == band
            r, c, score = r[good], c[good], score[good]
            i = rows.column("i")
            one, other = i.take(pa.array(r)).to_numpy(), i.take(pa.array(c)).to_numpy()
            kind = i.type
            columns = [rows.column("book_id").take(pa.array(r)), pa.array(np.minimum(one, other), kind), pa.array(np.maximum(one, other), kind), pa.array(score, pa.float64())]
            yield from pa.table(columns, names=["book_id", "a", "b", "score"]).combine_chunks().to_batches(max_chunksize=1 << 16)

    def run(batches):
        held: list = []  # the job so far: it may go on
        for batch in batches:
            jobs = batch.column("job").dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero(jobs[1:] != jobs[:-1]) + 1).tolist(), len(jobs)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    if held and held[-1].column("job")[-1].as_py() != batch.column("job")[lo].as_py():
                        yield from met(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from met(pa.Table.from_batches(held))

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer: few bytes are much work
    return dealt.repartition(parts, F.xxhash64("job")).sortWithinPartitions("job").mapInArrow(run, f"{shape}, score double")


def similar_pairs(chapters: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs of different bodies of one book with bigram Jaccard >= threshold:
    book_id, a, b (least indexes of their bodies, a < b), score. Every body is
    held against all of its book that are near enough in size: the work grows
    with the square of a book's bodies, memory does not (see _linked)."""
    sets = _sets(chapters)
    return _linked(sets, sets.select("book_id", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("value"), "i", "n"), threshold)


def approximate_pairs(chapters: DataFrame, threshold: float = 0.85, bands: int = 12, rows: int = 4) -> DataFrame:
    """similar_pairs by MinHash: bodies meet that agree in all `rows` least
    hashes of one of `bands` bands, and are verified on whole sets. A pair of
    similarity s is met with probability 1 - (1 - s^rows)^bands (0.9998 at 0.85
    with the defaults); none that is not similar is given."""
    sets = _sets(chapters, bands, rows)
    return _linked(sets, keep(sets.select("book_id", F.posexplode("bands").alias("band", "value"), "i", "n")), threshold)

"""Exact Jaccard join of word-shingle sets, by size-aware heavy and light sets.

Equal sets are first folded into classes. Over the classes, shingles have one
global order: rare ones by hash, then those that many texts share, by count.
A set of n shingles that reaches similarity t with a partner shares at least
o = ceil(t n) with it, so the two share the first k of their common shingles
within their first n - o + k. Light sets (n up to a boundary) enumerate the
SUBSET-element subsets of that prefix, and meet on an equal subset; heavy sets
scan the inverted lists of the single shingles of their prefix, in which every
set of at least t times the boundary is entered. The boundary is the size of
least estimated cost: subsets made against list entries met.

A list is not expanded into pairs. Its member that holds the list's shingle
earliest is its hub (a partial aggregate, no task holds a list): all others are
verified against it on their whole sets (one comparison a member), links are joined into components, and only members
of one list that are still in different components are paired with one
another, if their sizes and the shingles left after their places still allow
the similarity. So a group of thousands of copies costs one comparison each.

Null and empty texts have the empty set and link with nothing. A text with
fewer words than the shingle width has its whole sequence as its one shingle.
Rows with equal sets link. A null doc_id is kept as a row of its own (its
component is null). Rows of a repeated id are documents of their own
that bear one name; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SUBSET = 2
#: A shingle counts as shared by many when a task's window of texts sees it
#: COMMON times or more: at 2, one of m texts is seen once m is about the root
#: of the number of windows, so lists of shingles thought rare grow with that
#: root and their pairs with the input. At most TOP_COMMON of these take part in
#: the order (others are rare).
COMMON, TOP_COMMON = 2, 200_000
#: Estimated cost of meeting one list entry, in keys made.
MEET = 8.0
#: Candidate ids that may be broadcast (8 bytes each); more are joined.
BROADCAST_IDS = 500_000
_SET = "doc_id long, n int, h1 long, h2 long, sketch binary, keys array<struct<sig:long,pos:int>>"


def _needed(n, percent: int):
    """ceil(t n)."""
    return -(-n * percent // 100)


def _numbers(data: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return common.shingle_sets(*common.word_hashes(*common.text_buffers(data.column(1))), width)


#: Sizes from here on count as one for the boundary: such sets are heavy.
LARGE = 4096
#: Shingles that a task counts together (about 40 bytes each while it does).
WINDOW = 1_000_000


def statistics(texts: DataFrame, width: int) -> DataFrame:
    """One pass over the texts, written: counts of shingles that a task sees
    COMMON times or more (kind 0: shingle, n), the first shingle of each set in
    the order as far as the task knows it (kind 1), and the sets of each size
    (kind 2: size, n)."""
    names = ["kind", "value", "n"]

    def row(kind, value, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(value), kind), pa.int32()), pa.array(value, pa.int64()), pa.array(n, pa.int64())], names)

    def count(batches):
        common.forget()
        waiting, total, many = [], 0, {}

        def flush():
            found, counts = np.unique(np.concatenate(waiting), return_counts=True)
            keep = counts >= COMMON
            shared, counts, first = found[keep], counts[keep], []
            del found, keep
            yield row(0, shared.view(np.int64), counts)
            for s in waiting:
                rare = s[shared[np.minimum(np.searchsorted(shared, s), len(shared) - 1)] != s] if len(shared) else s
                first.append(rare[0] if len(rare) else s[0])
            first = np.array(first, np.uint64).view(np.int64)
            yield row(1, first, np.ones(len(first), np.int64))

        for batch in batches:
            for s in _numbers(batch, width):
                many[min(len(s), LARGE)] = many.get(min(len(s), LARGE), 0) + 1
                if len(s):
                    waiting.append(s)
                    total += len(s)
            if total > WINDOW:
                yield from flush()
                waiting, total = [], 0
        if waiting:
            yield from flush()
        yield row(2, np.array(sorted(many), np.int64), np.array([many[k] for k in sorted(many)], np.int64))

    return common.stage(texts.mapInArrow(count, "kind int, value long, n long"), "statistics")


def common_shingles(counted: DataFrame) -> np.ndarray:
    """Shingles that many texts share, ascending by count (the order's end)."""
    rows = counted.filter("kind = 0").groupBy("value").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.col("n").desc(), "value").limit(TOP_COMMON).toArrow()  # bounded
    order = np.lexsort((top["value"].to_numpy(), top["n"].to_numpy()))
    return top["value"].to_numpy()[order].view(np.uint64)


class Order:
    """The global order of shingles."""

    def __init__(self, shared: np.ndarray):
        by_hash = np.argsort(shared)
        self.shared, self.rank = shared[by_hash], by_hash

    def arrange(self, s: np.ndarray) -> np.ndarray:
        """A sorted set in global order."""
        if not len(self.shared) or not len(s):
            return s
        at = np.minimum(np.searchsorted(self.shared, s), len(self.shared) - 1)
        many = self.shared[at] == s
        return np.concatenate([s[~many], s[many][np.argsort(self.rank[at[many]])]])


def light_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Subsets of SUBSET shingles of the prefix: keys, places of their last."""
    n = len(s)
    prefix = s[: min(n, n - _needed(n, percent) + SUBSET)]
    pairs = np.array(list(combinations(range(len(prefix)), SUBSET)), np.int64).reshape(-1, SUBSET)
    key = np.zeros(len(pairs), np.uint64)
    for k in range(SUBSET):
        key += prefix[pairs[:, k]] * common._K[k]
    return common.mix(key), pairs[:, -1]


def heavy_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Single shingles of the prefix: keys, places."""
    n = len(s)
    prefix = s[: n - _needed(n, percent) + 1]
    return prefix ^ np.uint64(0x5851F42D4C957F2D), np.arange(len(prefix))


def boundary(sizes: list[tuple[int, int]], mean_list: float, percent: int) -> int:
    """The largest light size, by the cost of all sets: sizes has (n, sets)."""
    best, cost, at = 0, 0.0, 0.0
    for n, many in sorted(sizes):
        p = n - _needed(n, percent)
        subsets = (p + SUBSET) * (p + SUBSET - 1) / 2
        lists = (p + 1) * (1 + MEET * max(0.0, mean_list - 1))
        at += many * (subsets - lists)
        if at < cost:
            best, cost = n, at
    return best


def choose_boundary(counted: DataFrame, percent: int) -> int:
    """The boundary from the sets' sizes and the mean length of the lists that
    single shingles would have: entries over distinct ones (HLL), of the first
    shingles of sets. It decides the cost alone; any boundary gives the same links."""
    sizes = counted.filter("kind = 2").groupBy("value").agg(F.sum("n").alias("sets")).collect()  # at most LARGE rows
    met = counted.filter("kind = 1").agg(F.count(F.lit(1)).alias("entries"), F.approx_count_distinct("value").alias("lists")).first()
    return boundary([(r["value"], r["sets"]) for r in sizes if r["value"]], met["entries"] / max(met["lists"], 1), percent)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's counts in about n / 2 buckets. Sketches of two sets
    differ in at most as many bits as the sets differ in shingles."""
    bits = 1 << min(14, max(8, (len(s) // 2).bit_length()))
    at = (common.mix(s ^ common._K[6]) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").tobytes()


def may_reach(n1: int, a: bytes, n2: int, b: bytes, percent: int) -> bool:
    """False only where the sketches rule the similarity out."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), 0) for v in (x, y))
    apart = int(np.bitwise_count(x ^ y).sum())
    return 100 * (n1 + n2 - apart) >= percent * (n1 + n2 + apart)


def set_rows(texts: DataFrame, width: int, percent: int, order: np.ndarray, light: int) -> DataFrame:
    """Per text: n, the set's 128-bit hash, and its keys."""
    shared = texts.sparkSession.sparkContext.broadcast(Order(order))  # at most TOP_COMMON shingles
    from_size = _needed(light + 1, percent)  # smaller sets reach no heavy one

    def run(batches):
        common.forget()
        for batch in batches:
            sets = _numbers(batch, width)
            sketches = [sketch(s) for s in sets]
            sizes, h1, h2, sigs, places = [], [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            starts = [0]
            for s in sets:
                n, made = len(s), 0
                ordered = shared.value.arrange(s)
                for wanted, keys in ((SUBSET <= n <= light, light_keys), (n and (n >= from_size or _needed(n, percent) < SUBSET), heavy_keys)):
                    if wanted:
                        sig, place = keys(ordered, percent)
                        sigs.append(sig)
                        places.append(place)
                        made += len(sig)
                sizes.append(n)
                h1.append(common.mix(s * common._K[4]).sum(dtype=np.uint64))
                h2.append(common.mix(s ^ common._K[5]).sum(dtype=np.uint64))
                starts.append(starts[-1] + made)
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            struct = pa.StructArray.from_arrays([long(np.concatenate(sigs)), pa.array(np.concatenate(places), pa.int32())], ["sig", "pos"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), long(h1), long(h2), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), struct)], ["doc_id", "n", "h1", "h2", "sketch", "keys"])

    return texts.mapInArrow(run, _SET)


def verify(texts: DataFrame, sketches: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity. Sketches
    (doc_id, n, sketch) turn most others away before any set is shuffled."""

    def rule_out(batches):
        for batch in batches:
            a, b, *sides = (batch.column(k).to_pylist() for k in range(6))
            keep = [may_reach(*x, percent) for x in zip(*sides)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    second = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    possible = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "na", "ka", "nb", "kb")
    pairs = common.stage(possible.mapInArrow(rule_out, "a long, b long").distinct(), "possible")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    chosen = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _numbers(batch, width)], pa.binary())], ["doc_id", "s"])

    found = common.stage(chosen.mapInArrow(sets, "doc_id long, s binary"), "sets")

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = found.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    right = found.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    links = common.stage(joined.mapInArrow(compare, "a long, b long"), "links")
    common.release(found, pairs)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, component) of undirected links (a, b): the least node reachable,
    by alternating large-star and small-star steps until nothing changes."""
    edges = common.stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == state:
            break
        state = (now["n"], now["h"])
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        following = common.stage(small, "edges")
        common.release(edges)
        edges = following
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v"), F.col("v")).distinct())


def similar_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, class_id: the
    smallest doc_id reachable by links, and the smallest with an equal set."""
    spark = docs.sparkSession
    common.configure(spark)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    counted = statistics(texts, width)
    order = common_shingles(counted)
    light = choose_boundary(counted, percent)
    rows = common.stage(set_rows(texts, width, percent, order, light), "shingle_rows")
    known = rows.filter(F.col("doc_id").isNotNull())
    classes = known.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    many = common.stage(classes.filter("members > 1"), "classes")
    total = rows.count()
    # a class may hold a third of all rows: its rows are dealt to several tasks
    hot = common.hot_keys(many, ["h1", "h2"], "members", total)
    member = common.join_hot(known.select("doc_id", "n", "h1", "h2"), many.drop("members"), ["h1", "h2"], hot, "doc_id", "left")
    member = common.stage(member.select("doc_id", "n", "h1", "h2", F.coalesce("class_id", "doc_id").alias("class_id")), "members")
    copies = member.filter("class_id <> doc_id").select("doc_id", "h1", "h2").distinct()
    sketches = known.select("doc_id", "n", "sketch")
    reps = known.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, ["doc_id", "h1", "h2"], "left_anti")
    keys = reps.select("doc_id", "n", F.explode("keys").alias("k")).select("doc_id", "n", "k.sig", "k.pos")
    # lists of two or more with their hubs, counted in the tasks before the shuffle; a long list then is one
    # row on one side of a join, and its members are dealt to several tasks
    lists = keys.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("pos", "n", "doc_id")).alias("hub")).filter("m > 1")
    lists = common.stage(lists, "hubs")
    entries = lists.agg(F.sum("m")).first()[0] or 0
    listed = common.join_hot(keys, lists.drop("m"), ["sig"], common.hot_keys(lists, ["sig"], "m", entries), "doc_id")
    listed = common.stage(listed, "lists")
    common.release(lists)
    enough = lambda n1, p1, n2, p2: f"100 * (least({n1} - {p1}, {n2} - {p2}) + {SUBSET - 1}) >= {percent} * ({n1} + {n2} - (least({n1} - {p1}, {n2} - {p2}) + {SUBSET - 1})) and 100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2})"
    hubs = listed.filter("doc_id <> hub.doc_id").filter(enough("n", "pos", "hub.n", "hub.pos"))
    hubs = common.stage(hubs.select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b")).distinct(), "hub_pairs")
    links = verify(texts, sketches, hubs, width, percent)
    joined = common.stage(components(links), "joined")
    # members of one list that are still apart
    open_ = listed.join(joined, listed["doc_id"] == joined["node"], "left").select("sig", "doc_id", "n", "pos", F.coalesce("component", "doc_id").alias("c"))
    apart = open_.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("sig")
    open_ = common.stage(open_.join(apart, "sig", "left_semi"), "open_lists")
    x, y = open_.alias("x"), open_.alias("y")
    rest = x.join(y, F.col("x.sig") == F.col("y.sig")).filter("x.doc_id < y.doc_id and x.c <> y.c").filter(enough("x.n", "x.pos", "y.n", "y.pos"))
    rest = rest.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct().join(hubs, ["a", "b"], "left_anti")
    rest = common.stage(rest, "other_pairs")
    more = verify(texts, sketches, rest, width, percent)
    all_links = links.union(more)
    found = common.stage(components(all_links), "components")
    common.release(listed, open_, hubs, rest, joined, counted)
    hot = common.hot_keys(many, ["class_id"], "members", total)
    out = common.join_hot(member, found.withColumnRenamed("node", "class_id"), ["class_id"], hot, "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"), "class_id")
    nameless = rows.filter(F.col("doc_id").isNull()).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(nameless)

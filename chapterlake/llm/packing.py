"""Best-fit packing of pieces into fixed-capacity sequences.

Only the length histogram (at most `capacity` counts, whatever the corpus) is
gathered. Over it the configuration linear program

    minimise sum_c x_c   with   sum_c a_cl x_c >= n_l   for every length l

is solved by multiplicative weights: the more of a length's demand the mix so
far covers, the less it weighs, and one bounded knapsack dynamic program a
round prices, for every length, the full configuration of most weight that
holds it. The fractional counts are rounded down to whole sequences and the
program is solved again for the demand that is left, until no full
configuration is left; the small rest is put best-fit. Which sequence a piece
gets is then arithmetic on its rank among the pieces of its length, so no
piece passes through the driver and no group is gathered in one task.

Empty and null texts hold the end id alone (length 1). Rows repeat as they
are: each is packed. A null id is kept. An empty table gives no rows. Columns
other than the id and the text are not read. Ties of length are ranked by
input split and position. Texts of any length are cut into pieces of the
capacity, the first of which may be shorter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, tokens

#: How fast weights fall with coverage, the share of the scarcest length's
#: demand that a round covers at a time, and the rounds of one solution.
FALL, STEP, ROUNDS = 4.0, 0.9, 100


class Knapsack:
    """A bounded knapsack by dynamic programming: for every room up to capacity
    the pieces of most weight that fill it exactly. Multiplicities are split in
    powers of two."""

    def __init__(self, lengths: np.ndarray, weights: np.ndarray, most: np.ndarray, capacity: int):
        self.parts = []
        for l, w, m in zip(lengths.tolist(), weights.tolist(), most.tolist()):
            many, m = 1, min(m, capacity // l)
            while m > 0:
                many = min(many, m)
                self.parts.append((l, many, many * l, many * w))
                m, many = m - many, many * 2
        value = np.full(capacity + 1, -np.inf)
        value[0] = 0
        took = np.zeros((len(self.parts), capacity + 1), bool)
        for i, (_, _, size, worth) in enumerate(self.parts):
            gain = value[: capacity + 1 - size] + worth
            better = gain > value[size:]
            took[i, size:] = better
            np.copyto(value[size:], gain, where=better)
        self.value, self.took = value, np.ascontiguousarray(took.T)

    def fill(self, room: int) -> dict[int, int] | None:
        """Pieces of each length that fill room, if any do."""
        if not np.isfinite(self.value[room]):
            return None
        out: dict[int, int] = defaultdict(int)
        end = len(self.parts)
        while room:
            end = end - 1 - int(self.took[room, :end][::-1].argmax())
            l, many, size, _ = self.parts[end]
            out[l] += many
            room -= size
        return out


def fractional(counts: np.ndarray, capacity: int) -> dict[tuple, float]:
    """Full configurations and their (fractional) numbers by multiplicative
    weights. A length's weight grows faster than the length, so that long pieces
    are met first and short ones are left to fill up."""
    lengths = np.flatnonzero(counts)
    size = lengths * (1 + lengths / capacity)
    rest = counts.astype(float)
    mixed: dict[tuple, float] = defaultdict(float)
    for _ in range(ROUNDS):
        weights = size * np.exp(-FALL * (1 - rest[lengths] / counts[lengths]))
        most = rest[lengths].astype(np.int64)
        open_ = most > 0
        priced = Knapsack(lengths[open_], weights[open_], most[open_], capacity)
        met = False
        for l in lengths[open_][np.argsort(-weights[open_], kind="stable")].tolist():
            config = priced.fill(capacity - l) if rest[l] >= 1 else None
            if config is None:
                continue
            config[l] += 1
            room = min(rest[k] / a for k, a in config.items())
            if room < 1:  # another configuration of this round took its pieces
                continue
            x = max(1.0, STEP * room)
            mixed[tuple(sorted(config.items(), reverse=True))] += x
            for k, a in config.items():
                rest[k] -= a * x
            met = True
        if not met:
            break
    return mixed


def configured(counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """(configurations and whole numbers of sequences, counts left over): the
    program's solution rounded down, solved again for the rest."""
    left, out, taken = np.asarray(counts, np.int64).copy(), [], True
    while taken and left.any():
        taken = False
        for config, x in fractional(left, capacity).items():
            if many := int(x + 1e-9):
                out.append((dict(config), many))
                taken = True
                for l, a in config:
                    left[l] -= a * many
    return out, left


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict, int]]:
    """Best-fit decreasing on counts: (contents, how many such sequences)."""
    open_: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    for l in np.flatnonzero(left)[::-1].tolist():
        n = int(left[l])
        for room in sorted(r for r in open_ if r >= l and open_[r]):
            groups, fit = open_.pop(room), room // l
            for contents, many in groups:
                full = min(many, n // fit)
                if full:
                    open_[room - fit * l].append((contents + ((l, fit),), full))
                    n -= full * fit
                many -= full
                if many and n and n < fit:
                    open_[room - n * l].append((contents + ((l, n),), 1))
                    many, n = many - 1, 0
                if many:
                    open_[room].append((contents, many))
        fit = capacity // l
        if n // fit:
            open_[capacity - fit * l].append((((l, fit),), n // fit))
        if n % fit:
            open_[capacity - n % fit * l].append((((l, n % fit),), 1))
    out = []
    for groups in open_.values():
        for contents, many in groups:
            whole: dict[int, int] = defaultdict(int)
            for l, a in contents:
                whole[l] += a
            out.append((dict(whole), many))
    return out


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations and whole numbers of sequences that use every piece: the
    program's, and best fit for what it leaves. While there are more sequences
    than the tokens need, configurations with the shortest pieces are given
    back, twice as many each time, if best fit saves a sequence with them."""
    made, left = configured(counts, capacity)
    made = sorted(made, key=lambda c: -min(c[0]))
    total = int((np.asarray(counts) * np.arange(len(counts))).sum())
    many_of = lambda plan: sum(many for _, many in plan)
    best, back = made + best_fit(left, capacity), 1
    while many_of(best) > -(-total // capacity) and back < 2 * len(made):
        kept, left = made[: max(0, len(made) - back)], np.array(counts, np.int64)
        for contents, many in kept:
            for l, a in contents.items():
                left[l] -= a * many
        tried = kept + best_fit(left, capacity)
        best = tried if many_of(tried) < many_of(best) else best
        back *= 2
    return best


def slots(planned: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, pieces per sequence, first sequence,
    offset in the sequence), ascending by rank."""
    out, given, sequence = defaultdict(list), defaultdict(int), 0
    for contents, many in planned:
        offset = 0
        for l, a in sorted(contents.items(), reverse=True):
            out[l].append((given[l], a, sequence, offset))
            given[l] += a * many
            offset += a * l
        sequence += many
    return {l: np.array(rows, np.int64) for l, rows in out.items()}


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with length (1 to capacity), split
    (any grouping of the rows) and nth (0, 1, ... among the rows of the same
    split and length)."""
    spark = pieces.sparkSession
    per_split = pieces.groupBy("split", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    firsts = per_split.select("split", "length", F.coalesce(before, F.lit(0)).alias("first"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    where = spark.sparkContext.broadcast(slots(plan(counts, capacity)))  # bounded by the histogram, not the rows
    ranked = pieces.join(firsts, ["split", "length"]).withColumn("rank", F.col("first") + F.col("nth")).drop("split", "first", "nth")
    kept = [f for f in ranked.schema.fields if f.name != "rank"]

    def place(batches):
        table = where.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, edges) if len(order) else []:
                l = int(length[rows[0]])
                t = table[l]
                t = t[np.searchsorted(t[:, 0], rank[rows], "right") - 1]
                q, at = np.divmod(rank[rows] - t[:, 0], t[:, 1])
                sequence[rows], offset[rows] = t[:, 2] + q, t[:, 3] + at * l
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*(f.name for f in kept), "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenises `doc_id, text`, ends each document with id 0, cuts those over
    capacity and packs the pieces.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    with with_ids the piece's little-endian unsigned 32-bit ids (`ids`). The
    short piece of a cut document is its first.
    """
    common.configure(docs.sparkSession)
    fields = "doc_id long, piece int, start long, length int, ids_crc32 long, nth long" + ", ids binary" * with_ids

    def cut(batches):
        encode = tokens.encoder(tokenizer).encode
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                edge = n % capacity or min(n, capacity)
                start = 0
                for k, end in enumerate(range(edge, n + 1, capacity)):
                    part, length = ids[4 * start : 4 * end], end - start
                    rows.append((doc, k, start, length, zlib.crc32(part), seen[length], part)[: 6 + with_ids])
                    seen[length] += 1
                    start = end
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "ids"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) if rows else [[]] * (6 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names[: 6 + with_ids])

    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, fields)
    pieces = common.stage(pieces.withColumn("split", F.spark_partition_id()), "pieces")
    return assign(pieces, capacity).withColumn("length", F.col("length").cast("long"))

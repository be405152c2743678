"""Quality scores by a factorisation machine.

Features: hashed words (presence, scaled by the root of their number), bins of
structure statistics over the whole text, and bins of numeric metadata
columns. Pairs interact through low-rank factors, summed in linear time as
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). Trained with numpy by
AdaGrad on at most SAMPLE_ROWS labelled rows (those of least hash of doc_id).

Null and empty texts have the structure bins of zero and get a score too. Null
metadata has a bin of its own; negative values count as 0. Any label above 0
is a 1. Texts of any length are read whole. Rows repeat as they are. An empty
table gives no rows; without labelled rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 5000
WORD_BITS, FACTORS = 14, 4
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.08, 1e-4
BINS = 12
#: Byte classes whose shares are statistics (fixed values).
CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "newline": (10,), "stop": b".,;:?'\"-", "bang": b"!",
    "symbol": b"#$%&*+/<=>@\\^_`{|}~()[]", "other": range(128, 256), "control": [*range(0, 9), *range(14, 32)],
}
STATISTICS = [*CLASSES, "words", "word_length", "distinct_words", "distinct_lines", "top_word"]


def _bin(ratio: np.ndarray) -> np.ndarray:
    """0 for zero, else 1 + the octave of a ratio from 2^-10 to 1."""
    return np.where(ratio > 0, np.clip(np.floor(np.log2(np.maximum(ratio, 1e-9)) + BINS - 1), 1, BINS - 1), 0).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, metadata: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of texts: (feature, value, where each text's begin)."""
    n, sizes = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    shares = []
    for members in CLASSES.values():
        table, counts = common.byte_class(members), np.zeros(n)
        for lo, hi in _groups(offsets):
            run = np.concatenate([[0], np.cumsum(table[data[offsets[lo] : offsets[hi]]])])
            counts[lo:hi] = np.diff(run[offsets[lo : hi + 1] - offsets[lo]])
        shares.append(counts / sizes)
    words, begins = common.word_hashes(data, offsets, common.ALNUM)
    lines, line_begins = common.word_hashes(data, offsets, ~common.byte_class([10]))
    many = np.diff(begins)
    bucket = words >> np.uint64(64 - WORD_BITS)
    rows, cells, values, distinct, top, own_lines = [], [], [], np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        found, counts = np.unique(bucket[begins[k] : begins[k + 1]], return_counts=True)
        rows.append(found.astype(np.int64))
        values.append(np.full(len(found), 1 / np.sqrt(max(len(found), 1))))
        distinct[k] = len(np.unique(words[begins[k] : begins[k + 1]])) / max(many[k], 1)
        top[k] = counts.max() / many[k] if len(counts) else 0
        own = line_begins[k + 1] - line_begins[k]
        own_lines[k] = len(np.unique(lines[line_begins[k] : line_begins[k + 1]])) / own if own else 0
    letters = shares[0] + shares[1] + shares[2] + shares[8]
    stats = [*shares, np.minimum(many / 2**BINS, 1), np.minimum(letters * sizes / np.maximum(many, 1) / 32, 1), distinct, own_lines, top]
    bins = [_bin(s) for s in stats]
    # finer bins where the share is near 1
    bins = [np.where(s > 0.5, BINS + np.minimum(((s - 0.5) * 2 * 8).astype(np.int64), 7), b) for s, b in zip(stats, bins)]
    width = BINS + 8
    for m in metadata:
        bins.append(np.where(np.isnan(m), BINS + 7, np.clip(np.floor(np.log2(np.maximum(np.nan_to_num(m), 0) + 1) / 2), 0, BINS - 1)).astype(np.int64))
    base = 1 << WORD_BITS
    for k in range(n):
        cells.append(np.concatenate([rows[k], [base + j * width + int(b[k]) for j, b in enumerate(bins)]]).astype(np.int64))
        values[k] = np.concatenate([values[k], np.ones(len(bins))])
    starts = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int64)
    return (np.concatenate(cells) if n else np.zeros(0, np.int64)), (np.concatenate(values) if n else np.zeros(0)), starts


def _groups(offsets: np.ndarray):
    """Ranges of texts of about STEP_BYTES together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + common.STEP_BYTES, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class FactorisationMachine:
    def __init__(self, size: int, seed: int = 7):
        self.bias, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, FACTORS))

    def raw(self, cells, values, starts):
        at = starts[:-1]
        linear = np.add.reduceat(self.w[cells] * values, at)
        vx = self.v[cells] * values[:, None]
        total = np.add.reduceat(vx, at)
        return self.bias + linear + 0.5 * (total**2 - np.add.reduceat(vx**2, at)).sum(1), vx, total

    def score(self, cells, values, starts) -> np.ndarray:
        if len(starts) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(cells, values, starts)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> "FactorisationMachine":
        rng, size = np.random.default_rng(seed), len(self.w)
        sum_w, sum_v, sum_b = np.full(size, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), BATCH):
                part = order[lo : lo + BATCH]
                cells = np.concatenate([rows[k][0] for k in part])
                values = np.concatenate([rows[k][1] for k in part])
                sizes = [len(rows[k][0]) for k in part]
                starts = np.concatenate([[0], np.cumsum(sizes)])
                raw, vx, total = self.raw(cells, values, starts)
                d = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
                each = np.repeat(d, sizes) * values
                gw = np.bincount(cells, each, size) + DECAY * self.w
                gv = np.stack([np.bincount(cells, each * (np.repeat(total[:, f], sizes) - vx[:, f]), size) for f in range(FACTORS)], 1) + DECAY * self.v
                sum_w += gw**2
                sum_v += gv**2
                sum_b += d.sum() ** 2
                self.w -= RATE * gw / np.sqrt(sum_w)
                self.v -= RATE * 0.5 * gv / np.sqrt(sum_v)
                self.bias -= RATE * d.sum() / np.sqrt(sum_b)
        return self


def size_of(metadata: int) -> int:
    return (1 << WORD_BITS) + (len(STATISTICS) + metadata) * (BINS + 8)


def _numbers(batch: pa.RecordBatch, places: list[int]) -> list[np.ndarray]:
    return [np.array(batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for k in places]


def sample_labels(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled ids, those of least hash."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", (F.col(label) > 0).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)


def labelled(docs: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """columns and label of the chosen ids: one row an id and label (the least
    where ids repeat), so that a repeated id is not gathered whole."""
    rows = docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")  # bounded by the sample
    least = rows.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("r")).select("doc_id", "r.*")
    return least.join(F.broadcast(chosen), "doc_id").select(*columns, "label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine | None:
    """Trains on docs (doc_id, text, metadata) joined with labels (doc_id,
    label 0 or 1)."""
    common.configure(docs.sparkSession)
    chosen = sample_labels(labels, label, sample_rows)
    rows = labelled(docs, chosen, ["text", *metadata]).select("text", "label", *metadata)

    def run(batches):
        common.forget()
        for batch in batches:
            cells, values, starts = features(*common.text_buffers(batch.column(0)), _numbers(batch, range(2, 2 + len(metadata))))
            part = lambda x, t: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, t))
            yield pa.RecordBatch.from_arrays([batch.column(1), part(cells, pa.int32()), part(values, pa.float32())], ["label", "cells", "vals"])

    table = rows.mapInArrow(run, "label int, cells array<int>, vals array<float>").toArrow()  # at most sample_rows rows
    if not table.num_rows:
        return None
    y = table["label"].to_numpy().astype(float)
    as_rows = [(c.values.to_numpy().astype(np.int64), v.values.to_numpy().astype(float)) for c, v in zip(table["cells"], table["vals"])]
    order = sorted(range(len(y)), key=lambda k: (y[k], as_rows[k][0].tobytes()))  # independent of the rows' arrival
    return FactorisationMachine(size_of(len(metadata))).fit([as_rows[k] for k in order], y[order])


def score(docs: DataFrame, model: FactorisationMachine | None, metadata: tuple[str, ...] = (), keep_text: bool = True) -> DataFrame:
    """Adds score (0 to 1) to docs by its text and metadata columns; a
    column of that name is replaced."""
    common.configure(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    docs = docs.drop("score")
    names, passed = docs.columns, [c for c in docs.columns if keep_text or c != "text"]
    text, places = names.index("text"), [names.index(m) for m in metadata]

    def run(batches):
        common.forget()
        machine = shared.value
        for batch in batches:
            if machine is None:
                out = np.full(len(batch), 0.5)
            else:
                out = machine.score(*features(*common.text_buffers(batch.column(text)), _numbers(batch, places)))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in passed), pa.array(out, pa.float64())], [*passed, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in passed)
    return docs.mapInArrow(run, f"{schema}, score double")

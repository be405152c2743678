"""Toxicity by a linear classifier over character n-grams scaled by naive
Bayes log-count ratios.

A feature is the presence in a text of a hashed n-gram of characters (code
points, A-Z lower-cased), its value the log ratio of its smoothed rates in toxic and other texts.
The SELECTED n-grams of most significant ratio enter a logistic regression,
trained with numpy. All counts come from at most SAMPLE_ROWS labelled rows
(those of least hash of doc_id); whole texts are read and scored.

Null and empty texts have no n-gram and get the score of the intercept. Rows
repeat as they are. An empty table gives no rows; without labelled rows, or
with one label only, scores are that label's share (0 without rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, quality

SAMPLE_ROWS, SELECTED = 8000, 4096
SIZES, BITS = (3, 4, 5), 18
STEPS, RATE, DECAY = 300, 0.05, 2e-5


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, A-Z lower-cased, and where each text's begin (n + 1)."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    first, tail = padded[lead], [padded[lead + k] & 0x3F for k in (1, 2, 3)]
    points = np.where(
        first < 0x80, common.LOWER[first & 0x7F],
        np.where(first < 0xE0, (first & 0x1F) << 6 | tail[0], np.where(first < 0xF0, (first & 0x0F) << 12 | tail[0] << 6 | tail[1], (first & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2])),
    )
    return points.astype(np.uint32), np.searchsorted(lead, offsets)


#: Odd weights of the characters of an n-gram by place.
_PLACES = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(max(SIZES))], np.uint64)


def buckets(points: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each code point but the last n - 1."""
    gram = np.full(max(0, len(points) - n + 1), n, np.uint64)
    for k in range(n):
        gram += (points[k : k + len(gram)].astype(np.uint64) + np.uint64(1)) * _PLACES[k]
    return common.mix(gram) >> np.uint64(64 - BITS)


def hits(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs of n-grams of characters, of wanted buckets only."""
    found = []
    for lo, hi in quality._groups(offsets):
        points, begins = characters(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        ends = begins[1:]
        for step in range(0, len(points), common.STEP_BYTES):  # of a text longer than a step, too
            part = points[step : step + common.STEP_BYTES + max(SIZES) - 1]
            for n in SIZES:
                bucket = buckets(part, n)[: common.STEP_BYTES]
                ok = np.ones(len(bucket), bool) if wanted is None else wanted[bucket]
                for j in range(1, n):  # none reaches into the next text
                    gone = ends - j - step
                    ok[gone[(gone >= 0) & (gone < len(ok))]] = False
                at = np.flatnonzero(ok)
                doc = np.searchsorted(ends, at + step, "right") + lo
                found.append(np.unique((doc.astype(np.uint64) << np.uint64(BITS)) | bucket[at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(found))
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Model:
    """Weight per bucket (0 where not selected) and intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept, self.wanted = weights, intercept, weights != 0

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        doc, bucket = hits(data, offsets, self.wanted)
        raw = self.intercept + np.bincount(doc, self.weights[bucket], n)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on docs (doc_id, text) joined with labels (doc_id, label)."""
    spark = docs.sparkSession
    common.configure(spark)
    chosen = quality.sample_labels(labels, label, sample_rows)
    rows = common.stage(quality.labelled(docs, chosen, ["text"]), "toxic_sample")

    def count(batches):
        sums = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            doc, bucket = hits(*common.text_buffers(batch.column(0)), None)
            y = batch.column(1).to_numpy()[doc] > 0
            for k in (0, 1):
                sums[k] += np.bincount(bucket[y == bool(k)], minlength=1 << BITS)
        at = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "other", "toxic"])

    sizes = {r["label"] > 0: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        share = n1 / max(n0 + n1, 1)
        common.release(rows)
        return Model(np.zeros(1 << BITS), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    table = rows.mapInArrow(count, "bucket long, other long, toxic long").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()  # at most 2^BITS rows
    other, toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = table["bucket"].to_numpy()
    other[at], toxic[at] = table["other"].to_numpy(), table["toxic"].to_numpy()
    ratio = np.log((toxic + 1) / (n1 + 2)) - np.log((other + 1) / (n0 + 2))
    strength = np.abs(ratio) / np.sqrt(1 / (toxic + 1) + 1 / (other + 1))
    strength[other + toxic < 3] = 0
    top = np.lexsort((np.arange(1 << BITS), -strength))[:SELECTED]
    wanted = np.zeros(1 << BITS, bool)
    wanted[top[strength[top] > 0]] = True
    shared = spark.sparkContext.broadcast(wanted)

    def pick(batches):
        for batch in batches:
            doc, bucket = hits(*common.text_buffers(batch.column(0)), shared.value)
            starts = np.searchsorted(doc, np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(bucket, pa.int32()))], ["label", "cells"])

    picked = rows.mapInArrow(pick, "label int, cells array<int>").toArrow()  # at most sample_rows rows
    y = picked["label"].to_numpy().astype(float)
    lists = [c.values.to_numpy() for c in picked["cells"]]
    order = sorted(range(len(y)), key=lambda k: (y[k], lists[k].tobytes()))  # independent of the rows' arrival
    y = (y[order] > 0).astype(float)
    cells = np.concatenate([lists[k] for k in order]).astype(np.int64)
    doc = np.repeat(np.arange(len(y)), [len(lists[k]) for k in order])
    x = ratio[cells]
    w, b = np.zeros(1 << BITS), float(np.log(n1 / n0))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(doc, w[cells] * x, len(y)), -30, 30)))
        d = (p - y) / len(y)
        g, gb = np.bincount(cells, d[doc] * x, 1 << BITS) + DECAY * w, d.sum()
        m, mb = 0.9 * m + 0.1 * g, 0.9 * mb + 0.1 * gb
        v, vb = 0.999 * v + 0.001 * g**2, 0.999 * vb + 0.001 * gb**2
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    w = np.where(wanted, w * ratio, 0)
    common.release(rows)
    return Model(w, b)


def score(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """Adds score (0 to 1) to docs by its column text; a column
    of that name is replaced."""
    common.configure(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    docs = docs.drop("score")
    names, passed = docs.columns, [c for c in docs.columns if keep_text or c != "text"]
    place = names.index("text")

    def run(batches):
        for batch in batches:
            out = shared.value.score(*common.text_buffers(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in passed), pa.array(out)], [*passed, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in passed)
    return docs.mapInArrow(run, f"{schema}, score double")

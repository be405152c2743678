"""Language identification by a byte convolutional network.

Byte embedding, filters of several widths, ReLU, max pooling over a window of
fixed length, softmax; trained with numpy on labelled windows and applied to
every window of every text, so that whole texts count. A document's
probabilities are the mean over its windows.

Fitted on at most SAMPLE_ROWS labelled rows (those of least hash of doc_id,
text) and SAMPLE_WINDOWS windows of each. Null text or text without a letter:
`und`, score 0. Rows repeat as they are; ties between languages go to the
first in alphabetical order. An empty table gives no rows; without labelled
rows every text is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS, SAMPLE_WINDOWS = 3000, 2
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 12, 6
EPOCHS, BATCH, RATE = 5, 64, 0.01
SPAN = max(WIDTHS)
STEP = WINDOW - SPAN + 1  #: so each place of the widest filter is seen once


class ByteCnn:
    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        n = len(WIDTHS) * FILTERS
        self.mask = np.zeros((SPAN, EMBED, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(SPAN * EMBED, n)
        self.params = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filters": (rng.normal(0, 0.3, (SPAN * EMBED, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "dense": rng.normal(0, 0.1, (n, len(classes))).astype(np.float32),
            "out": np.zeros(len(classes), np.float32),
        }

    def _pool(self, windows: np.ndarray):
        p = self.params
        x = p["embed"][windows]
        z = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), SPAN * EMBED, 1)[:, ::EMBED]
        z = np.ascontiguousarray(z)
        y = z.reshape(-1, SPAN * EMBED) @ p["filters"]
        return z, y.reshape(len(x), STEP, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax of windows (n, WINDOW) of bytes."""
        p = self.params
        pooled = np.maximum(self._pool(windows)[1].max(1) + p["bias"], 0)
        e = pooled @ p["dense"] + p["out"]
        e = np.exp(e - e.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def fit(self, windows: np.ndarray, y: np.ndarray, seed: int = 7) -> "ByteCnn":
        p, rng = self.params, np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v = {k: np.zeros_like(x) for k, x in p.items()}
        t = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), BATCH):
                rows = order[lo : lo + BATCH]
                w, n = windows[rows], len(rows)
                z, conv = self._pool(w)
                at = conv.argmax(1)
                best = np.take_along_axis(conv, at[:, None], 1)[:, 0] + p["bias"]
                pooled = np.maximum(best, 0)
                e = pooled @ p["dense"] + p["out"]
                e = np.exp(e - e.max(1, keepdims=True))
                d = e / e.sum(1, keepdims=True)
                d[np.arange(n), y[rows]] -= 1
                d /= n
                g = {"dense": pooled.T @ d, "out": d.sum(0)}
                back = (d @ p["dense"].T) * (best > 0)
                g["bias"] = back.sum(0)
                picked = z[np.arange(n)[:, None], at]  # row, filter, span
                g["filters"] = np.einsum("rf,rfs->sf", back, picked) * self.mask
                to_z = (back[:, :, None] * p["filters"].T[None]).reshape(n, -1, SPAN, EMBED)
                g["embed"] = np.zeros_like(p["embed"])
                for j in range(SPAN):
                    np.add.at(g["embed"], w[np.arange(n)[:, None], at + j], to_z[:, :, j])
                t += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows of WINDOW bytes, the text of each); a text's windows follow
    one another and the last is filled up with zero bytes."""
    sizes = np.diff(offsets)
    many = np.maximum(1, -(-np.maximum(sizes - SPAN + 1, 1) // STEP))
    doc = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    at = (offsets[:-1][doc] + nth * STEP)[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][doc][:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8), doc
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0), doc


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ByteCnn | None:
    """Trains on the labelled rows of docs (text, lang; hash order by doc_id)."""
    length = F.greatest(F.length("text") - WINDOW, F.lit(1))
    shots = F.array(*[F.substring(F.col("text"), (F.pmod(F.xxhash64("text", F.lit(k)), length) + 1).cast("int"), F.lit(WINDOW)) for k in range(SAMPLE_WINDOWS)])
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    near = common.least_hashed(known.select("doc_id", "lang", "text"), F.xxhash64("doc_id"), sample_rows)
    rows = near.filter(F.col("text").rlike(r"\p{L}")).select("lang", shots.alias("shots")).collect()  # bounded
    classes = sorted({r["lang"] for r in rows})
    if not classes:
        return None
    texts = [s.encode() for r in rows for s in r["shots"]]
    y = np.array([classes.index(r["lang"]) for r in rows for _ in r["shots"]])
    # whole windows, and short ones as short texts have
    texts = [t[: WINDOW if k % 4 else max(20, len(t) // 4)] for k, t in enumerate(texts)]
    offsets = np.concatenate([[0], np.cumsum([min(len(t), WINDOW) for t in texts])])
    windows, _ = cut_windows(np.frombuffer(b"".join(t[:WINDOW] for t in texts), np.uint8), offsets)
    return ByteCnn(classes).fit(windows, y)


def predict(docs: DataFrame, model: ByteCnn | None, keep_text: bool = True) -> DataFrame:
    """Adds lang_pred and score to docs by its column text; columns of these
    names are replaced."""
    common.configure(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    docs = docs.drop("lang_pred", "score")
    names, passed = docs.columns, [c for c in docs.columns if keep_text or c != "text"]
    place = names.index("text")

    def run(batches):
        common.forget()
        net = shared.value
        for batch in batches:
            column = batch.column(place)
            data, offsets = common.text_buffers(column)
            n = len(column)
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if net is None:
                mean = np.zeros((n, 1))
                letters[:] = False
            else:
                total, many = np.zeros((n, len(net.classes))), np.zeros(n)
                for windows, doc in steps(data, offsets):
                    p = net.probabilities(windows)
                    for c in range(p.shape[1]):
                        total[:, c] += np.bincount(doc, p[:, c], n)
                    many += np.bincount(doc, minlength=n)
                mean = total / np.maximum(many, 1)[:, None]
            best = mean.argmax(1)
            said = [net.classes[b] if ok else "und" for b, ok in zip(best, letters)]
            score = np.where(letters, np.clip(mean.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in passed), pa.array(said, pa.string()), pa.array(score)], [*passed, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in passed)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def steps(data: np.ndarray, offsets: np.ndarray, windows: int = 512):
    """Windows of a batch of texts, `windows` at a time."""
    lo = 0
    n = len(offsets) - 1
    while lo < n:
        hi = lo + 1
        while hi < n and offsets[hi + 1] - offsets[lo] <= windows * STEP and hi - lo < windows:
            hi += 1
        if hi == lo + 1 and offsets[hi] - offsets[lo] > windows * STEP:  # a long text, by parts
            for at in range(int(offsets[lo]), int(offsets[hi]), windows * STEP):
                end = min(int(offsets[hi]), at + windows * STEP + SPAN - 1)
                w, d = cut_windows(data[at:end], np.array([0, end - at]))
                yield w[:windows], np.full(min(len(w), windows), lo)
        else:
            w, d = cut_windows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield w, d + lo
        lo = hi

"""Helpers that the operators of this subpackage share.

Texts reach Python as Arrow batches; the numpy helpers below work on the
UTF-8 buffers directly, so no Python string is made per word.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes per Arrow batch for text tables: a few MB of text at usual
#: lengths, and no more than the bytes (or one row) where texts are very long.
TEXT_ROWS, TEXT_BYTES = 1000, 32 << 20
#: Bytes of text that one numpy step works on.
STEP_BYTES = 1 << 20


#: Functions that drop what a reused worker still remembers for an operator.
caches: list = []


def forget() -> None:
    """Drops what this worker remembers for other operators, and gives Arrow's
    free memory back. A task of much memory of its own calls it first."""
    for drop in caches:
        drop()
    pa.default_memory_pool().release_unused()


def configure(spark: SparkSession) -> None:
    """Bound the Arrow batches of text operators. Plans read these settings
    when they run, so the session keeps them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where
    it is set; else a temporary folder on a local master, or the warehouse if it
    is not a folder of one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = "file://" + tempfile.mkdtemp(prefix="chapterlake-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stage"
            if found.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chapterlake/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again, so that
    later jobs depend on files that outlive any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete staged tables that no later result reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2. A null id is never held out."""
    return F.coalesce((F.crc32(doc_id.cast("string")) % 4) == 2, F.lit(False))


def least_hashed(rows: DataFrame, key, limit: int) -> DataFrame:
    """At most `limit` rows of rows, those of least key (a hash). Rows far from
    the least are filtered before they are ordered, so a task sends few."""
    n = rows.count()
    near = rows.withColumn("_h", key).filter(F.pmod("_h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2.0 * limit / max(n, 1))))
    return near.orderBy(F.pmod("_h", F.lit(1 << 30)), "_h", *[c for c in rows.columns if c in ("doc_id", "id", "lang")]).limit(limit).drop("_h")


#: A key is hot that holds over 1 / HOT of the rows (there are fewer than HOT
#: such keys); its rows are dealt to SALTS parts.
HOT, SALTS = 1000, 64


def hot_keys(counted: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """Keys of counted (`n` rows each, `total` rows in all at least) that are hot:
    fewer than HOT rows, each once."""
    return counted.filter(F.col(n) * HOT > total).select(*on).distinct()


def join_hot(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, spread, how: str = "inner") -> DataFrame:
    """left joined to right on `on`, the rows of left's hot keys parted by
    `spread` and met with a copy of right's row in each part. Both sides are
    read once; hot keys (fewer than HOT) are broadcast. A null key is not hot
    and meets nothing."""
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    left = left.join(hot, on, "left").withColumn("_salt", salt).drop("_hot")
    right = right.join(hot, on, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def byte_class(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Words [^\x20\x09-\x0D]+ .
NOT_SPACE = ~byte_class(SPACES)
#: Words of letters and digits; every byte of a non-ASCII character counts.
ALNUM = byte_class([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _powers:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(STEP_BYTES + 1, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def cuts(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> list[int]:
    """Positions that part data into steps of about STEP_BYTES, each between
    two words or two texts."""
    out, n = [0], len(data)
    while n - out[-1] > STEP_BYTES:
        end = out[-1] + STEP_BYTES
        k = offsets[np.searchsorted(offsets, end, "right") - 1]
        if k > out[-1]:
            out.append(int(k))
            continue
        gaps = np.flatnonzero(~word[data[out[-1] + 1 : end]])
        if len(gaps) == 0:  # one word longer than a step: it is cut at the step, and its pieces are added up
            out.append(end)
        else:
            out.append(out[-1] + 1 + int(gaps[-1]))
    return [*out, n]


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes; no run crosses a text."""
    inside = word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1 : len(data)]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1 : len(data)]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = NOT_SPACE, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words begin (n + 1).

    The hash of a word depends on its bytes alone: it is mixed from a sum over
    its bytes, each weighted by its place. A word that steps cut is the sum of
    its pieces, each weighted by the place of its first byte.
    """
    power, inverse = _tables()
    sums, begins = [], []
    places = cuts(data, offsets, word)
    for lo, hi in zip(places, places[1:]):
        part = data[lo:hi]
        if not len(part):
            continue
        inner = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        s, e = word_spans(part, inner, word)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((fold[part].astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=prefix[1:])
        found, at = (prefix[e] - prefix[s]) * inverse[s], s + lo
        if lo and len(s) and s[0] == 0 and word[data[lo - 1]] and offsets[np.searchsorted(offsets, lo)] != lo:
            weight = pow(_BASE, lo - int(begins[-1][-1]), 1 << 64)  # the piece goes on with the word before it
            sums[-1][-1:] += found[:1] * np.uint64(weight)
            found, at = found[1:], at[1:]
        if len(found):
            sums.append(found)
            begins.append(at)
    if not sums:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return mix(np.concatenate(sums)), np.searchsorted(np.concatenate(begins), offsets)


_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(hashes: np.ndarray, begins: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct shingles of `width` words; with fewer
    words the whole sequence is the one shingle; without words, none."""
    n = len(hashes)
    if n == 0:
        return [np.zeros(0, np.uint64)] * (len(begins) - 1)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        full += hashes[k : n - width + 1 + k] * _K[k]
    full = mix(full)
    out = []
    for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(full[lo : hi - width + 1]))
        elif hi > lo:
            short = (hashes[lo:hi] * _K[: hi - lo]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def rows_out(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

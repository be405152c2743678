"""Sorted-string-table shards of token ids.

File layout: blocks | index | bloom | footer.
  block   zstd of entries (shared u16, rest u16, n u32, key rest, n ids as
          unsigned 16 or 32 bits), keys ascending and prefix-compressed
  index   per block: first key, place, length, documents, ids before it
  bloom   bits over all keys, BLOOM_BITS a key, BLOOM_HASHES probes
  footer  places and lengths of index and bloom, counts, id width, magic

Keys: byte 0 for a null id, else byte 1 and the id as big-endian 64 bits with
the sign turned, so byte order is id order. Repeated ids are all kept, ordered
by text. Null text is empty; a text of any length is one entry, which lies in
one block. Columns other than doc_id and text are not read. An empty table
gives no shard.
A shard's file has a name of its own attempt and is never renamed or written
over: the manifest, of which Spark commits one attempt a task, names the file
that counts. What a lost attempt wrote is named nowhere and read by nobody.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, tokens

BLOCK_IDS = 16_384  #: ids after which a block ends
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"CLSST001"
_FOOTER = struct.Struct("<QQQQQQB8s")
_CODEC = pa.Codec("zstd", 1)


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key) * 0x9E3779B1 & 0xFFFFFFFF | 1
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


class Writer:
    """Takes (key, ids as unsigned 32-bit bytes) in ascending order of keys."""

    def __init__(self, out, wide: bool):
        self.out, self.wide, self.place = out, wide, 0
        self.index, self.keys, self.entries = [], [], []
        self.first, self.last, self.in_block, self.ids = b"", b"", 0, 0

    def add(self, key: bytes, ids: bytes) -> None:
        if not self.entries:
            self.first = self.last = key
            shared = 0
        else:
            shared = _shared(self.last, key)
        n = len(ids) // 4
        body = ids if self.wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        self.entries.append(struct.pack("<HHI", shared, len(key) - shared, n) + key[shared:] + body)
        self.keys.append(key)
        self.last = key
        self.in_block += n
        if self.in_block >= BLOCK_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            raw = b"".join(self.entries)
            block = struct.pack("<Q", len(raw)) + _CODEC.compress(raw, asbytes=True)
            self.out.write(block)
            self.index.append((self.first, self.place, len(block), len(self.entries), self.ids))
            self.place += len(block)
            self.ids += self.in_block
            self.entries, self.in_block = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<HQQQQ", len(k), p, n, d, i) + k for k, p, n, d, i in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.keys:
            for b in _probes(key, bits):
                bloom[b >> 3] |= 1 << (b & 7)
        self.out.write(index + bloom.tobytes())
        self.out.write(_FOOTER.pack(self.place, len(index), self.place + len(index), bits, len(self.keys), self.ids, self.wide, MAGIC))


class Reader:
    """Reads a shard block by block; get() finds one key by Bloom filter,
    binary search of the sparse index and one block."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        at, n, bloom_at, self.bits, self.docs, self.n_ids, self.wide, magic = _FOOTER.unpack(source.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        raw, self.index, place = source.read_at(n, at), [], 0
        while place < len(raw):
            k, *rest = struct.unpack_from("<HQQQQ", raw, place)
            place += struct.calcsize("<HQQQQ")
            self.index.append((raw[place : place + k], *rest))
            place += k
        self.bloom = source.read_at(-(-self.bits // 8), bloom_at)

    def block(self, k: int):
        """(key, ids as unsigned 32-bit bytes) of a block's entries."""
        _, place, length, _, _ = self.index[k]
        raw = self.source.read_at(length, place)
        raw = _CODEC.decompress(raw[8:], struct.unpack("<Q", raw[:8])[0], asbytes=True)
        at, key, width = 0, b"", 4 if self.wide else 2
        while at < len(raw):
            shared, rest, n = struct.unpack_from("<HHI", raw, at)
            at += 8
            key = key[:shared] + raw[at : at + rest]
            at += rest
            ids = raw[at : at + n * width]
            at += n * width
            yield key, ids if self.wide else np.frombuffer(ids, "<u2").astype("<u4").tobytes()

    def __iter__(self):
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every document with this id."""
        key = key_of(doc_id)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _probes(key, self.bits)):
            return []
        found, firsts = [], [x[0] for x in self.index]
        k = max(0, bisect.bisect_left(firsts, key) - 1)
        while k < len(firsts) and firsts[k] <= key:
            found += [ids for own, ids in self.block(k) if own == key]
            k += 1
        return found


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, shards: int | None = None) -> DataFrame:
    """Tokenises `doc_id, text`, appends id 0 and writes shards under path in
    ascending doc_id order. Returns the manifest (shard, file, docs, n_ids,
    first_key, last_key), itself a Parquet table in path.

    Rows are dealt by ranges of (doc_id, text hash, row) from Spark's own sample
    of keys, so one id or one repeated row that holds many rows is split too.
    shards: by default the input's partitions. path is one that pyarrow's file
    systems know (file, hdfs, s3, gs, abfs).
    """
    spark = docs.sparkSession
    common.configure(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("row")
    _open(path)[0].create_dir(_open(path)[1], recursive=True)

    def write(batches):
        from pyspark import TaskContext

        shard, writer, out, docs_in, first, last = TaskContext.get().partitionId(), None, None, 0, b"", b""
        store, folder = _open(path)
        file = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        for batch in batches:
            coder = tokens.encoder(tokenizer)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = key_of(doc)
                if writer is None:
                    out = store.open_output_stream(f"{folder}/{file}")
                    writer, first = Writer(out, coder.tokenizer.get_vocab_size() > 65_536), key
                writer.add(key, coder.encode(text or "") + b"\0\0\0\0")
                docs_in, last = docs_in + 1, key
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [file], "docs": [docs_in], "n_ids": [writer.ids], "first_key": [first], "last_key": [last]})

    schema = "shard long, file string, docs long, n_ids long, first_key binary, last_key binary"
    ordered.mapInArrow(write, schema).write.parquet(f"{path}/manifest")
    return spark.read.schema(schema).parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Reads the shards of a path: doc_id, start (ids before the document),
    n_tokens, ids_crc32, and with with_ids the unsigned 32-bit ids."""
    manifest = spark.read.parquet(f"{path}/manifest")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row a shard
    files = manifest.select("shard", "file", F.coalesce(before, F.lit(0)).alias("base"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches):
        store, folder = _open(path)
        for batch in batches:
            for file, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with store.open_input_file(f"{folder}/{file}") as source:
                    reader = Reader(source)
                    for k, (_, _, _, _, ids_before) in enumerate(reader.index):
                        start, rows = base + ids_before, []
                        for key, ids in reader.block(k):
                            rows.append((id_of(key), start, len(ids) // 4, zlib.crc32(ids), ids)[: 4 + with_ids])
                            start += len(ids) // 4
                        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names[: 4 + with_ids])

    return files.repartition(n, "shard").mapInArrow(read, schema)


def lookup(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """The ids of the asked `doc_id`s, by point reads: each key finds the shards
    whose range holds it by binary search of their sorted bounds (one row a
    shard), and each shard answers through its filter and index. Returns doc_id,
    ids; absent ids give no row, repeated ones count once."""
    bounds = spark.read.parquet(f"{path}/manifest").select("shard", "file", "first_key", "last_key").orderBy("shard").collect()  # one row a shard
    shared = spark.sparkContext.broadcast(([r["file"] for r in bounds], [bytes(r["first_key"]) for r in bounds], [bytes(r["last_key"]) for r in bounds]))

    def meet(batches):
        files, firsts, lasts = shared.value  # shards follow one another, so both ascend
        for batch in batches:
            met = [(doc, files[k]) for doc in batch.column(0).to_pylist() for k in range(bisect.bisect_left(lasts, key_of(doc)), bisect.bisect_right(firsts, key_of(doc)))]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in met], pa.int64()), pa.array([f for _, f in met], pa.string())], ["doc_id", "file"])

    found = doc_ids.select(F.col("doc_id").cast("long")).distinct().mapInArrow(meet, "doc_id long, file string")

    def read(batches):
        store, folder = _open(path)
        for batch in batches:
            files = batch.column(1).to_pylist()
            out = {"doc_id": [], "ids": []}
            for file in set(files):
                with store.open_input_file(f"{folder}/{file}") as source:
                    reader = Reader(source)
                    for doc, own in zip(batch.column(0).to_pylist(), files):
                        if own == file:
                            for ids in reader.get(doc):
                                out["doc_id"].append(doc)
                                out["ids"].append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["ids"], pa.binary())], ["doc_id", "ids"])

    return found.repartition("file").mapInArrow(read, "doc_id long, ids binary")

"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a sample (principal axes, then iterative quantisation)
turns unit vectors into binary codes of one bit an axis. Codes are split into
substrings; each part of the table indexes its codes by every substring. For
a query, probing the substrings within the radius that the pigeonhole rule
gives finds every code within the Hamming radius; those are ranked again by
the exact cosine of the original vectors in double precision, each part keeps
its best, and the parts' lists are merged.

The radius is learned: on the sample it holds RECALL of true neighbours. A
sample's neighbours are farther than the whole table's, so the whole table's
recall is at least as high in expectation. A part with fewer than k codes
within the radius gives its k nearest codes instead, so no query is short.

Vectors null, zero, or with null or non-finite components take no part, nor do
those of other dimensions than the sample's commonest. Rows with a null id take
no part. Repeated vectors are separate rows; equal vectors have equal scores,
and ties go to the smaller id. Very large or small components are scaled by a
power of two, which leaves the cosine as it is. An empty table gives no rows.
Only id and vector are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SAMPLE_ROWS, RECALL, ROTATIONS = 6000, 0.97, 25
#: Queries that go to the tasks together; more are taken in blocks.
BLOCK_QUERIES = 10_000


class Codes:
    """The learned rotation, the radius and the substrings."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = x.mean(0)
        centred = x - self.mean
        d = x.shape[1]
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1]
        v = centred @ axes
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ROTATIONS):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        self.matrix = axes @ r
        self.bits = -(-d // 8) * 8
        self.dim = d
        asked = rng.permutation(len(x))[: min(400, len(x))]
        near = x[asked] @ x.T
        near[np.arange(len(asked)), asked] = -2
        code = self.of(x)
        n = min(k, len(x) - 1)
        far = [0]
        for q, s in zip(asked, near):
            best = np.argpartition(-s, n - 1)[:n] if n else np.zeros(0, np.int64)
            far += np.bitwise_count(code[best] ^ code[q]).sum(1).tolist()
        self.radius = int(np.quantile(far, RECALL, method="higher"))

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Codes (n, bits / 8) of unit vectors."""
        return np.packbits((unit - self.mean) @ self.matrix > 0, axis=1)

    def substrings(self, code: np.ndarray) -> np.ndarray:
        """A byte as two substrings of four bits: (n, bits / 4)."""
        return np.stack([code >> 4, code & 15], 2).reshape(len(code), -1)


#: Values of four bits by their distance from 0: flips of at most s bits.
_FLIPS = [[v for v in range(16) if v.bit_count() <= s] for s in range(5)]


def unit_rows(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors in double precision) of the rows that take part."""
    ids, vectors = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (ids, vectors))
    asked = pc.and_(ids.is_valid(), pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False))
    ids, vectors = ids.filter(asked), vectors.filter(asked)
    a = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null is NaN
    good = np.isfinite(a).all(1) & (a != 0).any(1)
    a = a[good]
    if len(a):
        far = np.frexp(np.abs(a).max(1))[1]
        odd = np.abs(far) > 300
        a[odd] = np.ldexp(a[odd], -far[odd, None])
    return ids.to_numpy(zero_copy_only=False)[good].astype(np.int64), a


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Norms of rows, summed row by row: equal rows have equal norms."""
    return np.sqrt((vectors * vectors).sum(1))


class Part:
    """The codes of a part of the table, indexed by every substring."""

    def __init__(self, codes: Codes, ids: np.ndarray, vectors: np.ndarray):
        self.codes, self.ids = codes, ids
        self.norms = lengths(vectors)
        self.vectors = vectors
        self.code = codes.of(vectors / self.norms[:, None])
        parts = codes.substrings(self.code)
        self.order = [np.argsort(p, kind="stable") for p in parts.T]
        self.starts = [np.searchsorted(p[o], np.arange(17)) for p, o in zip(parts.T, self.order)]

    def search(self, query_id: int, query: np.ndarray, code: np.ndarray, parts: np.ndarray, k: int):
        """(ids, scores) of the best k found."""
        m, r = len(parts), self.codes.radius
        s, extra = divmod(r, m)
        seen = np.zeros(len(self.ids), bool)
        for j in range(m):  # the first extra + 1 substrings to s flips, the others to s - 1
            own = s if j <= extra else s - 1
            for flip in _FLIPS[min(own, 4)] if own >= 0 else ():
                v = int(parts[j]) ^ flip
                seen[self.order[j][self.starts[j][v] : self.starts[j][v + 1]]] = True
        seen[self.ids == query_id] = False
        rows = np.flatnonzero(seen)
        far = np.bitwise_count(self.code[rows] ^ code).sum(1)
        rows = rows[far <= r]
        if len(rows) < k:
            others = self.ids != query_id
            far = np.where(others, np.bitwise_count(self.code ^ code).sum(1).astype(np.int64), 1 << 30)
            rows = np.argsort(far, kind="stable")[: min(k, int(others.sum()))]
        norm = lengths(query[None])[0]
        if len(rows) > 4 * k:  # a first pass by matrix product, wide enough for its rounding
            near = self.vectors[rows] @ query / (self.norms[rows] * norm)
            rows = rows[near >= np.partition(near, -k)[-k] - 1e-9]
        # one fixed order of summation a row, so that equal vectors score the same wherever they lie
        score = (self.vectors[rows] * query).sum(1) / (self.norms[rows] * norm)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def fit(vectors: DataFrame, k: int = 5, sample_rows: int = SAMPLE_ROWS) -> Codes | None:
    """Learns codes on the at most sample_rows rows of least hash of id, of
    those whose vectors can take part; null where there is none."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    known = vectors.filter(F.col("id").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)).select("id", "vector")
    rows = common.least_hashed(known, F.xxhash64("id"), sample_rows).toArrow()  # bounded
    sizes = pc.list_value_length(rows["vector"]).to_pylist()
    if not sizes:
        return None
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n))
    return Codes(unit_rows(rows["id"], rows["vector"], dim)[1], k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, part_rows: int = 20_000) -> DataFrame:
    """The k nearest found of each row of queries among vectors (both: id long,
    vector array), without the row of the query's own id: query_id, rank,
    vec_id, score."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    codes = fit(vectors, k)
    if codes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(codes)
    n = queries.count()
    blocks = max(1, -(-n // BLOCK_QUERIES))

    def block_of(block: int) -> DataFrame:
        rows = queries.select("id", "vector").filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()  # about BLOCK_QUERIES
        ids, asked = unit_rows(rows["id"], rows["vector"], codes.dim)
        wanted = spark.sparkContext.broadcast((ids, asked))

        def answer(parts):
            codes, (q_ids, q) = shared.value, wanted.value
            ids, vectors = (np.concatenate(x) for x in zip(*parts))
            if not len(ids) or not len(q_ids):
                return
            part = Part(codes, ids, vectors)
            code = codes.of(q / np.linalg.norm(q, axis=1, keepdims=True))
            sub = codes.substrings(code)
            out = [part.search(int(i), v, c, s, k) for i, v, c, s in zip(q_ids, q, code, sub)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, [len(a) for a, _ in out])), pa.array(np.concatenate([a for a, _ in out])), pa.array(np.concatenate([b for _, b in out]))], ["query_id", "vec_id", "score"])

        def run(batches):
            parts, n = [], 0
            for batch in batches:
                parts.append(unit_rows(batch.column(0), batch.column(1), codes.dim))
                n += len(parts[-1][0])
                if n >= part_rows:
                    yield from answer(parts)
                    parts, n = [], 0
            if parts:
                yield from answer(parts)

        found = vectors.select("id", "vector").mapInArrow(run, schema)
        if blocks > 1:  # the driver holds one block at a time
            found = common.stage(found, "near")
            wanted.unpersist()
        return found

    found = reduce(DataFrame.unionByName, [block_of(b) for b in range(blocks)])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Centroid clustering over a vantage-point tree.

Vectors become integers, floor(scale * x), and are written once; every round
reads them again. A round builds a vantage-point tree over the centroids and
broadcasts it (k centroids: its size is bounded by the parameters). Each vector
searches the tree best first: of its open nodes the one of least lower bound
comes next, and the search ends when that bound exceeds the radius of the best
centroid found. The radius is inclusive, so that a centroid as near as the best
is still met, and the smaller number wins. Distances in the nodes are exact
integers; lower bounds are rounded down. A batch of vectors advances together,
each along its own path. Tasks send one sum per cluster and axis.

Vectors that are null, of another length, or hold null or non-finite components
take no part, nor do those with an integer beyond LARGEST, whose squared
distances would not fit 64 bits. A vector of null id is clustered but never a
start. Repeated rows are separate vectors; of starts with equal hashes the
smaller vector comes first. Fewer vectors than k give as many centroids; an
empty table gives no rows. Only id and vector are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Largest integer of a component: 64 squares of a difference stay under 2^63.
LARGEST = 1 << 27
#: Centroids in a leaf; cells (vectors times nodes) that one step works on.
LEAF, CELLS = 4, 1 << 20
#: Relative slack of lower bounds, far over the rounding of square roots.
SLACK = 1e-9


class Tree:
    """Inner nodes hold one centroid, the vantage point, and two children with
    the range of their centroids' distances from it; leaves hold up to LEAF."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids = centroids
        members, children, ranges = [], [], []

        def node(ids: np.ndarray, low: float, high: float) -> int:
            at = len(members)
            members.append(np.pad(ids[:leaf] if len(ids) <= leaf else ids[:0], (0, max(0, leaf - len(ids)) if len(ids) <= leaf else leaf), constant_values=-1))
            children.append([-1, -1])
            ranges.append((low, high))
            return at

        todo = [(np.arange(len(centroids)), node(np.arange(len(centroids)), 0.0, 0.0))]
        while todo:
            ids, at = todo.pop()
            if len(ids) <= leaf:
                continue
            tried = ids[:: max(1, len(ids) // 32)]  # the vantage point whose distances spread most
            far = [np.sqrt(self.distances(centroids[ids], np.full(len(ids), v)).astype(float)) for v in tried]
            best = int(np.argmax([f.var() for f in far]))
            rest, away = ids[ids != tried[best]], far[best][ids != tried[best]]
            order = np.argsort(away, kind="stable")
            members[at] = np.array([tried[best], *[-1] * (leaf - 1)])
            for side, part in enumerate(np.array_split(order, 2)):
                below = np.sort(rest[part])
                children[at][side] = node(below, away[part].min(), away[part].max())
                todo.append((below, children[at][side]))
        self.members, self.children, self.ranges = np.array(members), np.array(children), np.array(ranges)

    def distances(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Exact squared distances of vectors to the centroids of numbers."""
        d = vectors - self.centroids[numbers]
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each vector;
        the smaller number of equally near ones."""
        step = max(1, CELLS // max(len(self.members), vectors.shape[1], 1))
        parts = [self._nearest(vectors[k : k + step]) for k in range(0, len(vectors), step)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([n for n, _ in parts]), np.concatenate([d for _, d in parts])

    def _nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(vectors)
        best, number, radius = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.centroids)), np.full(n, np.inf)
        bound = np.full((n, len(self.members)), np.inf)
        bound[:, 0] = 0
        active = np.arange(n)
        while len(active):
            open_ = bound[active]
            node = open_.argmin(1)
            low = open_[np.arange(len(active)), node]
            going = (low <= radius[active]) & (low < np.inf)
            active, node, low = active[going], node[going], low[going]
            bound[active, node] = np.inf
            vantage = np.zeros(len(active))
            for j in range(self.members.shape[1]):
                held = np.flatnonzero(self.members[node, j] >= 0)
                if not len(held):
                    break
                own, c = active[held], self.members[node[held], j]
                d = self.distances(vectors[own], c)
                nearer = (d < best[own]) | ((d == best[own]) & (c < number[own]))
                best[own[nearer]], number[own[nearer]] = d[nearer], c[nearer]
                if j == 0:
                    vantage[held] = np.sqrt(d.astype(float))
            radius[active] = np.sqrt(best[active].astype(float)) * (1 + SLACK)
            inner = np.flatnonzero(self.children[node, 0] >= 0)
            for side in (0, 1):
                child = self.children[node[inner], side]
                near, far = self.ranges[child, 0], self.ranges[child, 1]
                apart = np.maximum(vantage[inner] - far, near - vantage[inner]) - SLACK * (vantage[inner] + far)
                bound[active[inner], child] = np.maximum(low[inner], apart)
        return number, best


def integer_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(id, v array<int>) of the vectors (id, vector) that take part."""

    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(scale * flat.reshape(-1, dim))
            ok = np.isfinite(x).all(1) & (np.abs(x) <= LARGEST).all(1)
            own = x[ok].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, dim), pa.int32()), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), lists], ["id", "v"])

    return vectors.select(F.col("id").cast("long"), "vector").filter(F.size("vector") == dim).mapInArrow(run, "id long, v array<int>")


def _ints(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.int64)


def starts(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of least hash of `salt:id`, in that order."""
    hashed = kept.filter(F.col("id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    rows = hashed.orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors."""
    k, dim = centroids.shape
    tree = kept.sparkSession.sparkContext.broadcast(Tree(centroids))  # k centroids

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            v = _ints(batch.column(0), dim)
            number, _ = tree.value.nearest(v)
            order = np.argsort(number, kind="stable")
            found, first = np.unique(number[order], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(v[order], first, axis=0)
            n += np.bincount(number, minlength=k)
        own = np.flatnonzero(n)
        cluster, axis = np.repeat(own, dim), np.tile(np.arange(dim), len(own))
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(axis, pa.int32()), pa.array(n[cluster]), pa.array(sums[cluster, axis])], ["cluster", "axis", "n", "total"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    rows = kept.select("v").mapInArrow(run, "cluster int, axis int, n long, total long").groupBy("cluster", "axis").agg(exact("n").alias("n"), exact("total").alias("total")).collect()  # k times dim rows
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["axis"]] = int(r["total"]) // int(r["n"])
    tree.unpersist()
    return out


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of kept vectors."""
    dim = centroids.shape[1]
    tree = kept.sparkSession.sparkContext.broadcast(Tree(centroids))  # k centroids

    def run(batches):
        for batch in batches:
            number, far = tree.value.nearest(_ints(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(far)], ["id", "cluster", "distance"])

    return kept.select("id", "v").mapInArrow(run, "id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2") -> tuple[DataFrame, np.ndarray]:
    """Clusters vectors (id, vector) in so many rounds: the vectors that take
    part with cluster and distance (id, cluster, distance; written in the
    shared folder), and the final centroids."""
    kept = common.stage(integer_vectors(vectors, dim, scale), "integers")
    centroids = starts(kept, k, salt).reshape(-1, dim)
    if not len(centroids):
        return kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    assigned = common.stage(assign(kept, centroids), "assigned")
    common.release(kept)
    return assigned, centroids


def summarised(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia and centroid_sha256 (the digest of
    the final centroid's components, joined by commas)."""
    total = F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")
    sums = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(total).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    shape = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    table = assigned.sparkSession.createDataFrame([(c, n, sum(sums.values()), digest[c]) for c, n in sums.items()], shape)
    return assigned.join(F.broadcast(table), "cluster")  # k rows

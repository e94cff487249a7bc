"""Integer k-means whose assignments are filtered by n-simplex projection.

A few pivots span a simplex.  The distances of a vector to the pivots, computed once and cached with it, fix it as the apex of a simplex over that
base: as many coordinates as pivots, the last one its height over the base.  For two apexes x and y the true distance lies between their Euclidean
distance and the one with the heights added instead of subtracted.  In each round the 16 centroids get apexes too; a centroid whose lower bound
is above the smallest upper bound is out, the rest is compared by exact integer distances.

Rounds are a pass over the cached table: tasks send a count and a sum of components for each cluster, Spark adds them, the driver gets one row
for each cluster.  Nothing is collected that grows with the input.

Defined results: vectors with another number of components, a null or non-finite one or one of ``vectors.LARGEST`` or more once scaled take no part; repeated rows are
vectors each; vectors without an id take part and are chosen last as first centroids; with fewer vectors than centroids each vector is one; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm.common import written
from tidemark.llm.vectors import exact_kind, integer_vectors, matrix

#: Rows handled at once.
ROWS = 1 << 14
#: A pivot is taken if its height over the pivots before it is at least this part of its distance to the first.
LEAST_HEIGHT = 0.1


def squared(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to integer points."""
    a, b = vectors.astype(np.int64), points.astype(np.int64)
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    kind = exact_kind(4.0 * float(max(aa.max(initial=0), bb.max(initial=0))))
    kind = np.int64 if kind is np.int64 else np.float64
    return aa[:, None] + bb[None, :] - 2 * (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Simplex:
    """The base: pivots and, in rows, their coordinates (lower triangular)."""

    def __init__(self, candidates: np.ndarray, most: int):
        chosen, base = [], np.zeros((0, 0))
        for i in range(len(candidates)):
            if len(chosen) == most:
                break
            if not chosen:
                chosen, base = [i], np.zeros((1, 0))
                continue
            self.pivots, self.base = candidates[chosen], base
            to = squared(candidates[i:i + 1], self.pivots)
            apex = self.project(to)[0]
            if apex[-1] ** 2 > LEAST_HEIGHT ** 2 * to[0, 0]:
                chosen.append(i)
                base = np.vstack([np.hstack([base, np.zeros((len(base), 1))]), apex])
        self.pivots, self.base = candidates[chosen], base

    def project(self, distances: np.ndarray) -> np.ndarray:
        """Apexes from squared distances to the pivots: |x - pivot|^2 for all pivots, solved one coordinate after another."""
        d = distances.astype(np.float64)
        n = len(self.base)
        out = np.zeros((len(d), n))
        for j in range(1, n):
            own = self.base[j]
            rest = d[:, 0] + own @ own - d[:, j] - 2 * out[:, :j - 1] @ own[:j - 1]
            out[:, j - 1] = rest / (2 * own[j - 1])
        out[:, n - 1] = np.sqrt(np.maximum(0, d[:, 0] - (out[:, :n - 1] ** 2).sum(axis=1)))
        return out


def possible(apexes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """True where the lower bound to a point does not exceed the smallest upper bound; rounding is allowed for."""
    own, other = (apexes ** 2).sum(axis=1)[:, None], (points ** 2).sum(axis=1)[None, :]
    low = own + other - 2 * apexes @ points.T
    high = low + 4 * apexes[:, -1:] * points[:, -1][None, :]
    slack = 1e-6 * (1 + own + other)
    return low - slack <= (high + slack).min(axis=1, keepdims=True)


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller one of equals, and the squared distance to it."""
    fine = possible(apexes, points)
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    number = np.zeros(len(vectors), dtype=np.int64)
    for c in range(len(centroids)):
        rows = np.flatnonzero(fine[:, c])
        if rows.size:
            distance = squared(vectors[rows], centroids[c:c + 1])[:, 0]
            closer = distance < best[rows]
            best[rows[closer]] = distance[closer]
            number[rows[closer]] = c
    return number, best


def _cut(batches):
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            yield batch.slice(begin, ROWS)


def cluster(rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1:", pivots: int = 8) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector; ``k`` centroids are known to every task."""
    spark = rows.sparkSession
    kept = integer_vectors(rows.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{vector}`").alias("vector")).filter(F.size("vector") == dims), "vector", scale)
    first = kept.orderBy(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).asc_nulls_last(), "vector").limit(k).select("vector").collect()
    id_field = StructField("id", kept.schema["id"].dataType)
    if not first:
        empty = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], StructType([id_field, *StructType.fromDDL(empty).fields])).withColumnRenamed("id", row_id)
    centroids = np.array([r.vector for r in first], dtype=np.int64)
    simplex = Simplex(centroids, pivots)

    def project(batches):
        for batch in _cut(batches):
            if batch.num_rows:
                apexes = simplex.project(squared(matrix(batch.column("vector")), simplex.pivots))
                flat = pa.array(apexes.ravel())
                offsets = pa.array(np.arange(0, len(flat) + 1, apexes.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.ListArray.from_arrays(offsets, flat)], names=["id", "vector", "apex"])

    cached = written(kept.mapInArrow(project, StructType([id_field, *StructType.fromDDL("vector array<int>, apex array<double>").fields])), "centroid-apexes")

    def assigned(batch, centroids, points):
        apexes = batch.column("apex").flatten().to_numpy().reshape(batch.num_rows, points.shape[1])
        vectors = matrix(batch.column("vector"))
        return vectors, *nearest(vectors, apexes, centroids, points)

    for _ in range(rounds):
        def sums(batches, centroids=centroids, points=simplex.project(squared(centroids, simplex.pivots))):
            total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
            for batch in _cut(batches):
                if batch.num_rows:
                    vectors, number, _ = assigned(batch, centroids, points)
                    count += np.bincount(number, minlength=len(centroids))
                    for c in np.unique(number).tolist():
                        total[c] += vectors[number == c].sum(axis=0, dtype=np.int64)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"cluster": used, "n": count[used], "sums": list(total[used])}, schema=pa.schema([("cluster", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

        parts = cached.mapInArrow(sums, "cluster long, n long, sums array<long>")
        added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dims)]).alias("sums")).collect()
        centroids = centroids.copy()
        for r in added:
            centroids[r.cluster] = np.array(r.sums, dtype=np.int64) // r.n

    points = simplex.project(squared(centroids, simplex.pivots))

    def final(batches):
        for batch in _cut(batches):
            if batch.num_rows:
                _, number, distance = assigned(batch, centroids, points)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    found = written(cached.mapInArrow(final, StructType([id_field, *StructType.fromDDL("cluster int, distance long").fields])), "centroid-assignment")
    inertia = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # one row for each cluster, at most k
    facts = spark.createDataFrame([(c, total, sum(inertia.values()), shas[c]) for c, total in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(row_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

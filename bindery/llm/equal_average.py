"""Centroid clustering: exact integer k-means by equal-average equal-variance search.

A vector's nearest centroid is looked for in order of component means: the
centroids are sorted by mean, and the scan goes outward from the vector's own
mean. For vectors x, c of d components with sums Sx, Sc and deviations
Vx = sqrt(sum (x_i - Sx / d)^2), Vc,

    |x - c|^2  >=  (Sx - Sc)^2 / d + (Vx - Vc)^2.

The first term alone, in integers, ends the scan on both sides once the nearer
side exceeds the best distance so far; both together, with a margin for rounding,
reject single centroids. What is left is compared by its exact integer distance.

A round is one narrow pass over the vectors. Each task adds up its own clusters, so
``k`` rows leave a task, Spark adds these, and ``k`` centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from bindery.llm.rows import written

DIMS, CLUSTERS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3:"
ROUNDING = 1e-9


def kept_rows(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and integer components of the vectors that take part."""
    vectors = batch.column("embedding")
    batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False))
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(batch.num_rows, dims)
    finite = np.isfinite(x).all(1)  # a null component has become NaN
    x = np.floor(scale * x[finite])
    if len(x) and np.abs(x).max() * dims >= 2**30:
        raise ValueError(f"components times {scale} must stay below {2**30 // dims}: distances would not fit a long")
    return batch.column("vec_id").filter(pa.array(finite)), x.astype(np.int64)


class NearestCentroid:
    """The nearest of ``centroids`` (k, d) by squared distance; ties go to the smaller number."""

    def __init__(self, centroids: np.ndarray):
        self.number = np.argsort(centroids.sum(1), kind="stable")
        self.centroids = centroids[self.number]
        self.sums, self.deviations = self._shape(self.centroids)

    @staticmethod
    def _shape(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums, d = x.sum(1), x.shape[1]
        return sums, np.sqrt((d * (x * x).sum(1) - sums * sums) / d)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) for each row of ``x``."""
        n, d = x.shape
        k, far = len(self.sums), np.int64(3_000_000_000)  # its square is beyond d times any distance
        sums, deviations = self._shape(x)
        best, label = np.full(n, (2**63 - 1) // d), np.full(n, k)
        right = np.searchsorted(self.sums, sums)
        left, live = right - 1, np.arange(n)
        while len(live):
            l, r, own = left[live], right[live], sums[live]
            to_left = np.where(l >= 0, own - self.sums[l], far)
            to_right = np.where(r < k, self.sums[np.minimum(r, k - 1)] - own, far)
            gap = np.minimum(to_left, to_right)
            inside = (gap * gap <= d * best[live]) & (gap < far)  # else all further ones fail too
            live, l, r, gap = live[inside], l[inside], r[inside], gap[inside]
            rightward = to_right[inside] <= to_left[inside]
            at = np.where(rightward, r, l)
            right[live] += rightward
            left[live] -= ~rightward

            v, w = deviations[live], self.deviations[at]
            apart = np.maximum(np.abs(v - w) - ROUNDING * (v + w), 0)
            near = (gap.astype(np.float64) ** 2 / d + apart**2) * (1 - ROUNDING) <= best[live]
            rows, at = live[near], at[near]
            off = x[rows] - self.centroids[at]
            distance, number = np.einsum("ij,ij->i", off, off), self.number[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < label[rows]))
            best[rows[better]], label[rows[better]] = distance[better], number[better]
        return label, best


def integer_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = kept_rows(batch, dims, scale)
            starts = pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(starts, pa.array(x.ravel()))], names=["vec_id", "q"])

    return vectors.mapInArrow(convert, "vec_id long, q array<bigint>")


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, salt: str) -> np.ndarray:
    """Vectors with the ``k`` smallest hashes of salt and id; of one id the smaller vector first."""
    hashed = integer_vectors(vectors.filter("vec_id is not null"), dims, scale).withColumn(
        "h", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    )
    rows = hashed.orderBy("h", "q").select("q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64).reshape(len(rows), dims)


def moved(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """The centroids after one round."""
    k = len(centroids)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, counts, sums = NearestCentroid(centroids), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = kept_rows(batch, dims, scale)[1]
            label = search.find(x)[0]
            counts += np.bincount(label, minlength=k)
            order = np.argsort(label, kind="stable")
            present, first = np.unique(label[order], return_index=True)
            if len(present):
                sums[present] += np.add.reduceat(x[order], first)
        rows = np.flatnonzero(counts)
        starts = pa.array(np.arange(0, len(rows) * dims + 1, dims, dtype=np.int32))
        totals = pa.ListArray.from_arrays(starts, pa.array(sums[rows].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(counts[rows]), totals], names=["cluster", "n", "totals"])

    parts = vectors.mapInArrow(add_up, "cluster long, n long, totals array<bigint>")
    exact = F.sum(F.col("total").cast("decimal(38,0)"))
    added = (
        parts.select("cluster", "n", F.posexplode("totals").alias("at", "total"))
        .groupBy("cluster", "at")
        .agg(F.sum("n").alias("n"), exact.alias("total"))
        .collect()
    )
    out = centroids.copy()
    for row in added:
        out[row.cluster, row.at] = int(row.total) // row.n
    return out


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) for each vector that takes part, and the final centroids.

    Vectors that are null, of another length than ``dims`` or hold a null or
    non-finite component take no part. Rows that repeat are rows of their own. A row
    without id is clustered but does not start a centroid; with fewer than ``k``
    others there are fewer centroids, with none the result is empty. Ties go to
    the smaller number. A component beyond what fits exact long distances is an
    error. Extra columns are ignored.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    centroids = first_centroids(vectors, k, dims, scale, salt)
    if len(centroids) == 0:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids, dims, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NearestCentroid(centroids)
        for batch in batches:
            ids, x = kept_rows(batch, dims, scale)
            label, distance = search.find(x)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(label.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    return written(vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters"), centroids


def digest(vectors: DataFrame) -> DataFrame:
    """One row per clustered vector with the inertia of its cluster and of all."""
    assigned, centroids = cluster(vectors)
    inertia = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [
        (i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for i, c in enumerate(centroids)
    ]
    per_cluster = assigned.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    # One row per centroid, CLUSTERS at most.
    return assigned.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", *per_cluster.columns[1:])

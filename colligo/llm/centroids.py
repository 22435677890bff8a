"""Centroid clustering of integer vectors; nearest centroids are found by the threshold algorithm.

For each dimension the centroids are sorted by their value there. A vector walks
each of these lists outward from its own value, one centroid in every dimension a
round, and takes the exact distance of every centroid that it meets for the first
time. A centroid not met yet is in every dimension at least as far away as that
list's next one, so the sum of the squared gaps at the frontiers bounds its
distance from below: once that sum is strictly greater than the best exact
distance, no other centroid can be nearer or as near. Ties go to the smaller
number.

Components are floor(scale * x) with x as double. A round sums each cluster's
vectors in the tasks and again by cluster; k rows reach the driver. All sums and
divisions are exact.

Defined results: vectors with another number of components, or with a null or
non-finite one, take no part and have no row; components beyond 2^27 in either
direction count as 2^27, since no long could hold their squared distances;
repeated rows are separate vectors; a null id hashes as empty text and keeps its
row; an inertia that no long can hold is null; fewer vectors than k make fewer centroids; an empty table gives an empty
table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.llm.common import staged

LIMIT = 1 << 27
#: Vectors whose walks run side by side.
STEP = 1024
FAR = np.iinfo(np.int64).max


def lattice(rows: DataFrame, dims: int, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x (integers) of the vectors that take part."""
    schema = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b["v"]), dims), False))
            x = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            ok = np.isfinite(x).all(axis=1)
            whole = np.clip(np.floor(scale * x[ok]), -LIMIT, LIMIT).astype(np.int32)
            ends = np.arange(len(whole) + 1, dtype=np.int32) * dims
            yield pa.RecordBatch.from_arrays([b["vec_id"].filter(pa.array(ok)), pa.ListArray.from_arrays(pa.array(ends), pa.array(whole.ravel()))], schema=schema)

    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return given.mapInArrow(run, "vec_id long, x array<int>")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed:id, in that order; equal hashes by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in vectors.orderBy(key, "x").limit(k).select("x").collect()], dtype=np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of every row of x, by the threshold algorithm."""
    k, dims = centroids.shape
    lists = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, lists, axis=0)
    column = np.arange(dims)
    best, number = np.full(len(x), FAR), np.full(len(x), k)
    for at in range(0, len(x), STEP):
        part = x[at : at + STEP]
        rows = np.arange(len(part))
        up = np.stack([np.searchsorted(values[:, d], part[:, d]) for d in range(dims)], axis=1)
        down = up - 1
        seen = np.zeros((len(part), k), dtype=bool)
        near, who = best[at : at + STEP], number[at : at + STEP]
        while len(rows):
            own, lo, hi = part[rows], down[rows], up[rows]
            below = np.where(lo >= 0, own - values[np.maximum(lo, 0), column], FAR)
            above = np.where(hi < k, values[np.minimum(hi, k - 1), column] - own, FAR)
            take = below <= above
            gap = np.where(take, below, above)
            # Lists are of one length, so a list that has ended has shown every centroid.
            more = (gap < FAR).all(axis=1)
            more[more] = (gap[more] ** 2).sum(axis=1) <= near[rows[more]]
            rows, take, lo, hi = rows[more], take[more], lo[more], hi[more]
            met = np.zeros((len(rows), k), dtype=bool)
            met[np.arange(len(rows))[:, None], lists[np.where(take, lo, hi), column]] = True
            i, j = np.nonzero(met & ~seen[rows])
            seen[rows] |= met
            exact = np.full((len(rows), k), FAR)
            exact[i, j] = ((part[rows[i]] - centroids[j]) ** 2).sum(axis=1)
            first = exact.argmin(axis=1)
            found = exact[np.arange(len(rows)), first]
            better = (found < near[rows]) | ((found == near[rows]) & (first < who[rows]))
            near[rows[better]], who[rows[better]] = found[better], first[better]
            down[rows], up[rows] = lo - take, hi + ~take
    return number, best


def _matrix(b: pa.RecordBatch, dims: int) -> np.ndarray:
    return b["x"].flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floored mean of each cluster, or what was there where a cluster is empty."""
    k, dims = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for b in batches:
            x = _matrix(b, dims)
            who, _ = nearest(x, centroids)
            order = np.argsort(who, kind="stable")
            count = np.bincount(who, minlength=k)
            held = np.flatnonzero(count)
            if len(held):
                sums[held] += np.add.reduceat(x[order], (np.cumsum(count) - count)[held])
            n += count
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], schema=schema)

    parts = vectors.select("x").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[d].cast("decimal(20,0)")).alias(f"s{d}") for d in range(dims)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
        out[r.cluster] = [int(r[f"s{d}"]) // r.n for d in range(dims)]
    return out


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, far = nearest(_matrix(b, centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(who, pa.int32()), pa.array(far)], schema=schema)

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = rows.sparkSession
    vectors = staged(lattice(rows, dims, scale, id_col, vector_col), "lattice")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    placed = staged(assign(vectors, centroids), "assigned")
    # k rows at most.
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    fits = lambda n: n if n <= FAR else None
    facts = [(c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(known, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

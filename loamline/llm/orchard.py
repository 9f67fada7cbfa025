"""Centroid clustering of integer vectors with Orchard's search.

Vectors with exactly `dim` components, none null or non-finite, become integers floor(scale * x); all arithmetic after that is exact. Centroids start as
the k vectors whose SHA-256 of `seed:id` is smallest. Each round assigns every vector to its nearest centroid (squared Euclidean distance; of ties the smaller number)
and moves every centroid that has vectors to their floored mean.

Orchard's search: each centroid has a list of the others in order of their distance from it. A vector walks the list of the best centroid so far,
skips those it has met, and jumps to the list of a closer one as soon as it finds it. It stops at the first centroid that is
strictly more than twice its current distance away from the best: by the triangle inequality none behind it is closer or as close. In squared terms: 4 times the squared
distance. All vectors of a batch take their steps together.

Only the centroids (k vectors, a parameter) pass the driver; each task sums its own vectors by centroid before anything is shuffled, so a cluster with most of
the rows costs k sums a task like any other.

Odd rows: vectors of another length, null vectors and those with a null, infinite or NaN component are left out, and so are those with a component whose integer is
beyond 2 ** 27 in size (no distance of two others can then leave 64 bits). A null id stays in the result but never starts a centroid. Repeated rows are vectors like others, and
equal ones may start several centroids (the smaller number then takes all their vectors and the others stay where they are, empty). With fewer than k vectors there are as many centroids as vectors with an id; with
none an empty result. A sum of distances beyond 64 bits is null. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LIMIT = 1 << 27
#: Entries of the table of met centroids (vectors x centroids) that a step may hold.
CELLS = 1 << 22


def integer_vectors(rows: DataFrame, key: str, column: str, dim: int = 64, scale: int = 64) -> DataFrame:
    """key and v (array of integers) of the vectors that are kept."""
    x = F.transform(F.col(column), lambda c: F.floor(c.cast("double") * scale))
    ok = F.forall(F.col(column), lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) <= float(LIMIT)), F.lit(False)))
    held = rows.select(F.col(key).alias("key"), F.when((F.size(column) == dim) & ok, F.col(column)).alias(column)).where(F.col(column).isNotNull())
    return held.select("key", x.cast("array<int>").alias("v"))


class Centroids:
    """Centroids with their neighbour lists."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.int64)
        self.between = np.stack([((self.points - p) ** 2).sum(1) for p in self.points])
        number = np.arange(len(points))
        self.lists = np.stack([np.lexsort((number, row)) for row in self.between])  # the centroid itself, or one in the same place, is first

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid of each vector, and how many distances that took."""
        n, k = len(x), len(self.points)
        best, d = np.zeros(n, np.int64), ((x - self.points[0]) ** 2).sum(1)
        base, at = best.copy(), np.zeros(n, np.int64)  # whose list is walked, and where
        met = np.zeros((n, k), bool)
        met[:, 0] = True
        walking, taken = np.arange(n), n
        while len(walking):
            other = self.lists[base[walking], at[walking]]
            near = self.between[base[walking], other] <= 4 * d[walking]  # else all behind it are farther than the best
            walking, other = walking[near], other[near]
            new = ~met[walking, other]
            rows, tried = walking[new], other[new]
            met[rows, tried] = True
            far = ((x[rows] - self.points[tried]) ** 2).sum(1)
            taken += len(rows)
            at[walking] += 1
            closer, tie = far < d[rows], (far == d[rows]) & (tried < best[rows])
            jump = rows[closer]
            d[jump], best[jump], base[jump], at[jump] = far[closer], tried[closer], tried[closer], 0
            best[rows[tie]] = tried[tie]  # as far away, so the list in hand serves it too
            walking = walking[at[walking] < k]
        return best, d, taken


def _slices(batch: pa.RecordBatch, dim: int, k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, CELLS // max(k, dim))
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, dim)


def sums(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """cluster, at (component) and total, summed within each task and then over tasks; component -1 is the number of vectors."""
    k, dim = centroids.points.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)  # a task would need 2 ** 36 vectors to leave 64 bits
        for batch in batches:
            for _, x in _slices(batch, dim, k):
                best = centroids.nearest(x)[0]
                order = np.argsort(best, kind="stable")
                which, first = np.unique(best[order], return_index=True)
                total[which, 1:] += np.add.reduceat(x[order], first, axis=0)
                total[:, 0] += np.bincount(best, minlength=k)
        cluster, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(at - 1, pa.int32()), pa.array(total[cluster, at], pa.int64())], ["cluster", "at", "total"])

    return vectors.select("v").mapInArrow(run, "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """Every centroid that has vectors goes to their mean, floored in each component."""
    points = centroids.points.copy()
    found: dict[int, dict[int, int]] = {}
    for r in sums(vectors, centroids).collect():  # k x (dim + 1) numbers at most
        found.setdefault(r["cluster"], {})[r["at"]] = int(r["total"])
    for c, total in found.items():
        points[c] = [total.get(i, 0) // total[-1] for i in range(points.shape[1])]
    return Centroids(points)


def assigned(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """key, cluster and distance (squared) of every vector."""
    k, dim = centroids.points.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _slices(batch, dim, k):
                best, d, _ = centroids.nearest(x)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(best, pa.int32()), pa.array(d, pa.int64())], ["key", "cluster", "distance"])

    return vectors.mapInArrow(run, f"key {vectors.schema['key'].dataType.simpleString()}, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:id`, in that order; of repeated ids the smaller vector first."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    return np.array([r["v"] for r in vectors.where(F.col("key").isNotNull()).orderBy(name, "v").limit(k).collect()], np.int64)


def cluster(rows: DataFrame, key: str, column: str, k: int = 16, rounds: int = 3, seed: int = 1, dim: int = 64, scale: int = 64) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 (of the final centroid's components in decimal, joined by commas) of every kept vector."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    vectors = written(integer_vectors(rows, key, column, dim, scale), "orchard-vectors")
    start = first_centroids(vectors, k, seed)
    if not len(start):
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    at = Centroids(start)
    for _ in range(rounds):
        at = moved(vectors, at)
    out = written(assigned(vectors, at), "orchard-assigned")
    held = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows at most
    fits = lambda n: n if n < 1 << 63 else None
    total = fits(sum(held.values()))
    about = [(c, fits(d), total, hashlib.sha256(",".join(map(str, at.points[c].tolist())).encode()).hexdigest()) for c, d in held.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

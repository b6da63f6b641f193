"""k-means of whole-number vectors with Elkan's bounds (operator 12): every figure is exact.

A vector keeps an upper bound of its distance to its centroid and a lower bound of the distance to each centroid, as 32-bit floats rounded
outwards: up and down. A pass computes a distance only where neither bound excludes the centroid: it is skipped if the lower
bound, or half the distance between the two centroids, is strictly above the upper one, so a centroid at equal distance is
always compared and the smaller number wins. After a centroid's move its bounds give way by the length of the move, rounded up.
Compared are squared distances in whole numbers.

A pass is a map over the vectors with their state, written to the shared folder; the state before it is removed then. Centroids are
few (k by the number of components) and go to the tasks with the code; sums come back as one row for each centroid and task, added up
by Spark. Rows of one table may repeat: each is a vector of its own. Null ids are allowed, they come last among the first centroids' hashes.
Numbers beyond vectors.LARGEST are taken as that. With fewer vectors than k there are as many centroids as vectors; an
empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import vectors
from panelwright.llm.common import removed, saved
from panelwright.sources.session import ship

#: Sums of products of numbers up to this are exact as doubles (64 components).
EXACT_DOUBLE = 1 << 22
STATE = "vec_id long, x array<int>, cluster int, upper float, lower array<float>"
LAST = "vec_id long, cluster int, distance long"


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.asarray(x, np.float32), np.float32(-np.inf)), np.float32(0))


def matrix(column: pa.ListArray, kind) -> np.ndarray:
    """The lists of a column as rows of a matrix; all have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


class Centroids:
    """Centroids, half their distances to each other, rounded down, and the lengths of their last moves, rounded up."""

    def __init__(self, points: list[list[int]], before: list[list[int]] | None = None):
        self.points = np.array(points, np.int64)
        gaps = self.points[:, None, :] - self.points[None, :, :]
        self.half = np.nextafter(np.sqrt((gaps * gaps).sum(2).astype(np.float64)) / 2, -np.inf)
        moves = self.points - np.array(points if before is None else before, np.int64)
        length = np.sqrt((moves * moves).sum(1).astype(np.float64))
        self.moves = np.where(length > 0, np.nextafter(length, np.inf), 0.0)


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, at: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroids, new bounds, exact squared distances where they are known (else -1), and for each
    vector how many distances were computed."""
    plain = max(np.abs(x).max(initial=0), np.abs(at.points).max(initial=0)) <= EXACT_DOUBLE
    x, points = (x.astype(np.float64), at.points.astype(np.float64)) if plain else (x, at.points)
    lower = np.where(at.moves > 0, down(lower.astype(np.float64) - at.moves), lower)
    moved = at.moves[cluster]
    upper = np.where(moved > 0, up(upper.astype(np.float64) + moved), upper)
    squared, computed = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)

    def measured(rows: np.ndarray, c) -> np.ndarray:
        gap = x[rows] - points[c]
        exact = np.einsum("ij,ij->i", gap, gap).astype(np.int64)
        computed[rows] += 1
        return exact

    def tightened(rows: np.ndarray) -> None:
        rows = rows[squared[rows] < 0]
        exact = measured(rows, cluster[rows])
        squared[rows], upper[rows] = exact, up(np.sqrt(exact.astype(np.float64)))
        lower[rows, cluster[rows]] = down(np.sqrt(exact.astype(np.float64)))

    for c in range(len(points)):
        within = lambda: (cluster != c) & ~(lower[:, c] > upper) & ~(at.half[cluster, c] > upper)  # noqa: B023, E731
        tightened(np.flatnonzero(within()))
        rows = np.flatnonzero(within())
        if len(rows):
            exact = measured(rows, c)
            distance = np.sqrt(exact.astype(np.float64))
            lower[rows, c] = down(distance)
            nearer = (exact < squared[rows]) | (exact == squared[rows]) & (c < cluster[rows])
            won = rows[nearer]
            cluster[won], squared[won], upper[won] = c, exact[nearer], up(distance[nearer])
    return cluster, upper, lower, squared, computed


def _step(at: Centroids, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vec_id, x, cluster, upper, lower = (batch.column(n) for n in ("vec_id", "x", "cluster", "upper", "lower"))
            numbers = matrix(x, np.int64)
            near, high, low, squared, _ = assign(numbers, cluster.to_numpy().copy(), upper.to_numpy().copy(), matrix(lower, np.float32), at)
            if last:
                gap = numbers - at.points[near]
                exact = np.where(squared < 0, np.einsum("ij,ij->i", gap, gap), squared)
                yield pa.RecordBatch.from_arrays([vec_id, pa.array(near, pa.int32()), pa.array(exact, pa.int64())], ["vec_id", "cluster", "distance"])
            else:
                ends = np.arange(0, low.size + 1, low.shape[1], dtype=np.int32)
                bounds = pa.ListArray.from_arrays(pa.array(ends), pa.array(low.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([vec_id, x, pa.array(near, pa.int32()), pa.array(high, pa.float32()), bounds], ["vec_id", "x", "cluster", "upper", "lower"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each cluster that the task has met: its vectors and their sum."""
    counts: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            x, cluster = matrix(batch.column("x"), np.int64), batch.column("cluster").to_numpy()
            for c in np.unique(cluster):
                own = x[cluster == c]
                counts[c] = counts.get(c, 0) + len(own)
                sums[c] = sums.get(c, 0) + own.sum(0)
    if counts:
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64())]
        columns = [list(counts), list(counts.values()), [sums[c].tolist() for c in counts]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["cluster", "n", "sums"])


def _means(state: DataFrame, before: list[list[int]]) -> list[list[int]]:
    """Componentwise floor of the means; an empty cluster's centroid stays. k rows for each component come back."""
    parts = state.select("x", "cluster").mapInArrow(_sums, "cluster int, n long, sums array<long>")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    after = [list(c) for c in before]
    for r in totals.collect():
        after[r["cluster"]][r["place"]] = r["total"] // r["n"]
    return after


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and exact squared distance of every vector of size components, none null or not finite, and the final centroids.

    The first centroids are the k vectors with the smallest sha256 of "<seed>:<key>", equal ones by their numbers. Each of rounds assigns all
    vectors and moves the centroids; then vectors are assigned once more.
    """
    spark = ship(df.sparkSession)
    fit = vectors.is_finite(F.col(vector)) & (F.size(vector) == size)
    rows = df.where(fit).select(F.col(key).cast("long").alias("vec_id"), vectors.whole(F.col(vector)).alias("x"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    points = [list(r["x"]) for r in rows.orderBy(drawn.asc_nulls_last(), "x").limit(k).collect()]
    if not points:
        return spark.createDataFrame([], LAST), []
    zeros = F.array_repeat(F.lit(0.0).cast("float"), len(points))
    path = saved(rows.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(float("inf")).cast("float").alias("upper"), zeros.alias("lower")))
    before = None
    for _ in range(rounds):
        after = saved(spark.read.parquet(path).mapInArrow(_step(Centroids(points, before), False), STATE))
        removed(spark, path)
        path, state = after, spark.read.parquet(after)
        before, points = points, _means(state, points)
    last = spark.read.parquet(path).mapInArrow(_step(Centroids(points, before), True), LAST)
    done = saved(last)
    removed(spark, path)
    return spark.read.parquet(done), points


def with_inertia(assigned: DataFrame, points: list[list[int]]) -> DataFrame:
    """assigned with the sums of distances over its cluster and over all (null where they exceed a long) and its centroid's digest.

    One row for each centroid is broadcast."""
    spark = assigned.sparkSession
    own = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = own.agg(F.try_sum("cluster_inertia").alias("inertia")).first()[0] if points else None
    digests = [(c, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(points)]
    digest = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    told = own.join(F.broadcast(digest), "cluster").withColumn("inertia", F.lit(total).cast("long"))
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

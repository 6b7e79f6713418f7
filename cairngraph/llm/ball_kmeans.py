"""Centroid clustering by ball k-means over whole numbers.

A cluster is a ball: its centroid, and as radius the greatest distance of a member. Only a centroid whose distance from a
ball's own is at most twice the radius can take a member from it: those are the ball's neighbours, in order of
their distance. A member's place in the ball tells which of them matter: in the stable core, nearer than half way to the first
neighbour, none does; in the annulus between half way to neighbour n and half way to n + 1 the first n do, and only these
distances are computed. The bounds are compared as squares in whole numbers, so ties are seen, and the result is that of
comparing every centroid.

A round reads every vector with its cluster once, assigns it and writes it to the shared folder; sums, counts and radii of the
k clusters are one aggregation over what was written. The radius of a ball that moved is its old radius plus its way. Only the
k centroids go through the driver and into the tasks.

Defined cases: a vector is kept if it has exactly `dims` components, none null, NaN, infinite or as large as LARGEST (so that
squares stay exact); others give no row; a null id is never a start; rows of one id are rows of their own, and as starts are
told apart by their vector; with fewer than k vectors each is a start; an empty cluster keeps its centroid; ties go to
the smaller number; other columns are ignored; ids of any type; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.llm.common import drop, map_arrow, written

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Bound of the components after scaling: squared distances of up to 64 of them stay below 2^63.
LARGEST = 1 << 27
#: Below this, products of vectors are exact in doubles (64 * 2^20 * 2^20 * 4 < 2^53).
EXACT_IN_DOUBLES = 1 << 20

Centroids = list[tuple[int, ...]]


def squared(a: Sequence[int], b: Sequence[int]) -> int:
    return sum((x - y) * (x - y) for x, y in zip(a, b, strict=True))


def twice_radius_squared(greatest: int, way: int) -> int:
    """A whole number not below (2 (sqrt(greatest) + sqrt(way)))^2: of a ball that moved since its radius was measured."""
    return 4 * (greatest + way + math.isqrt(4 * greatest * way) + 1)


def neighbours(centroids: Centroids, reach: Sequence[int | None]) -> list[list[tuple[int, int]]]:
    """(squared distance, number) of the centroids that a ball's members may belong to instead, nearest first.
    reach: the square of twice each ball's radius; None for a ball whose radius nobody knows."""
    out = []
    for i, c in enumerate(centroids):
        far = sorted((squared(c, d), j) for j, d in enumerate(centroids) if j != i)
        out.append([(d, j) for d, j in far if reach[i] is None or d <= reach[i]])
    return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from one centroid, exact."""
    if len(x) and max(np.abs(x).max(), np.abs(c).max()) < EXACT_IN_DOUBLES:
        d = x.astype(np.float64) - c
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assigned(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, near: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (the smaller number of equals) of every row of x, and its squared distance; own: the ball that
    each is a member of, near: the neighbours of each ball."""
    cluster, best = own.copy(), np.zeros(len(x), np.int64)
    for i in np.unique(own):
        members = np.flatnonzero(own == i)
        to_own = distances(x[members], centroids[i])
        best_here, now = to_own.copy(), np.full(len(members), i)
        for apart, j in near[i]:
            ring = np.flatnonzero(to_own >= -(-apart // 4))
            if not len(ring):
                break  # all that are left lie nearer than half way to this neighbour, and to those behind it
            d = distances(x[members[ring]], centroids[j])
            nearer = (d < best_here[ring]) | ((d == best_here[ring]) & (j < now[ring]))
            best_here[ring[nearer]], now[ring[nearer]] = d[nearer], j
        cluster[members], best[members] = now, best_here
    return cluster, best


def whole_vectors(df: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """id and q (whole components) of the vectors that are kept."""
    v = F.col(f"`{vector}`")
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    fits = F.forall(v, lambda x: F.coalesce(F.abs(scaled(x)) < F.lit(float(LARGEST)), F.lit(False)))
    kept = df.where((F.size(v) == dims) & fits)
    return kept.select(F.col(f"`{vec_id}`").alias("id"), F.transform(v, lambda x: F.floor(scaled(x)).cast("int")).alias("q"))


def starts(vectors: DataFrame, k: int, seed: int) -> Centroids:
    """The k vectors whose id has the least hash, in its order."""
    named = vectors.where(F.col("id").isNotNull()).withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    return [tuple(r.q) for r in named.orderBy("hash", "q").select("q").limit(k).collect()]


def _assign(state: DataFrame, centroids: Centroids, near: list[list[tuple[int, int]]]) -> DataFrame:
    points = np.array(centroids, np.int64)
    where = state.columns.index("cluster") if "cluster" in state.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column(1)
            x = q.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
            own = np.zeros(batch.num_rows, np.int64) if where is None else batch.column(where).to_numpy(zero_copy_only=False).astype(np.int64)
            cluster, distance = assigned(x, own, points, near)
            yield pa.RecordBatch.from_arrays([batch.column(0), q, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "q", "cluster", "distance"])

    kind = state.schema["id"].dataType.simpleString()
    return map_arrow(state, run, f"id {kind}, q array<int>, cluster int, distance bigint")


def _balls(state: DataFrame, k: int) -> tuple[list[tuple[int, list[int]] | None], list[int], list[int]]:
    """Of each cluster: (members, sums of the components) or None, the greatest squared distance, the sum of these."""
    each = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("greatest"), F.sum("distance").alias("inertia")).collect()
    parts = state.select("cluster", F.posexplode("q").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect()  # k * dims rows
    sums: list[dict[int, int]] = [{} for _ in range(k)]
    for r in parts:
        sums[r.cluster][r["at"]] = r.x
    balls: list[tuple[int, list[int]] | None] = [None] * k
    greatest, inertia = [0] * k, [0] * k
    for r in each:
        balls[r.cluster] = r.n, [x for _, x in sorted(sums[r.cluster].items())]
        greatest[r.cluster], inertia[r.cluster] = r.greatest, r.inertia
    return balls, greatest, inertia


def clustered(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), members and cluster_inertia of its cluster, inertia of all, centroid of every kept vector."""
    spark = df.sparkSession
    state, at = written(whole_vectors(df, vec_id, vector, dims, scale), "vectors")
    centroids = starts(state, k, seed)
    reach: list[int | None] = [None] * len(centroids)
    inertia: list[int] = []
    balls: list[tuple[int, list[int]] | None] = []
    for last in (*[False] * rounds, True) if centroids else ():
        new, new_at = written(_assign(state, centroids, neighbours(centroids, reach)), "assigned")
        drop(spark, at)
        state, at = new, new_at
        balls, greatest, inertia = _balls(state, len(centroids))
        if not last:
            moved = [c if b is None else tuple(s // b[0] for s in b[1]) for c, b in zip(centroids, balls, strict=True)]
            reach = [twice_radius_squared(g, squared(a, b)) for g, a, b in zip(greatest, centroids, moved, strict=True)]
            centroids = moved
    if not centroids:  # no vector at all, or none with an id to start from
        state = state.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance"))
    told = [(i, balls[i][0] if balls[i] else 0, inertia[i], sum(inertia), list(c)) for i, c in enumerate(centroids)]
    known = spark.createDataFrame(told, "cluster int, members bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    found = state.select("id", "cluster", "distance").join(F.broadcast(known), "cluster", "left")  # known: k rows
    return found.select(F.col("id").alias(vec_id), "cluster", "distance", "members", "cluster_inertia", "inertia", "centroid")


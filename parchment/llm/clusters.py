"""Centroid clustering by balls.

A cluster is a ball: its centroid and the distance of its farthest member. Each block of vectors that a task holds has its own
balls, which are smaller than those of the whole cluster and so have fewer neighbours. Only centroids nearer than twice the radius can
win a member of a ball; members nearer than half the distance of the nearest such neighbour are stable and stay without a
comparison, the others lie in annuli and are compared exactly with the neighbours whose bisectors their distance reaches.
Arithmetic is on whole numbers, so results do not hang on the order of sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

#: Components below this in size have squared distances that are exact in double precision, and beyond the second none that fit a long.
EXACT, MOST = 1 << 22, 1 << 26


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows of whole numbers to all centroids."""
    if not len(x) or max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) >= EXACT:
        return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1) if len(x) else np.zeros((0, len(centroids)), np.int64)
    a, c = x.astype(float), centroids.astype(float)
    return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def paired(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``x`` to one centroid."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) by all comparisons; of equals the smaller number."""
    d = squared(x, centroids)
    own = d.argmin(1)
    return own, d[np.arange(len(x)), own]


@dataclass
class Work:
    """How many distances to centroids were computed, and how many vectors were stable."""

    compared: int = 0
    stable: int = 0


def by_balls(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What ``nearest`` gives, from the clusters ``before`` that the rows were in.

    With d the distance of a member to its own centroid, a neighbour at distance e can win, or tie, only where e <= 2 d: in squares,
    e2 <= 4 d2. Neighbours are sorted by e2; those up to 4 d2 are the member's annulus.
    """
    work = work or Work()
    own, dist = before.copy(), np.zeros(len(x), np.int64)
    between = squared(centroids, centroids)
    for k in np.unique(before):
        at = np.flatnonzero(before == k)
        d = paired(x[at], centroids[k])
        dist[at] = d
        work.compared += len(at)
        others = np.delete(np.arange(len(centroids)), k)
        near = others[between[k, others] <= 4 * d.max()]  # those that the ball's radius reaches
        near = near[np.argsort(between[k, near], kind="stable")]
        annulus = np.searchsorted(between[k, near], 4 * d, "right")
        work.stable += int((annulus == 0).sum())
        for ring in np.unique(annulus[annulus > 0]):
            rows = np.flatnonzero(annulus == ring)
            rivals = np.sort(np.append(near[:ring], k))
            which, least = nearest(x[at[rows]], centroids[rivals])
            own[at[rows]], dist[at[rows]] = rivals[which], least
            work.compared += len(rows) * int(ring)
    return own, dist


def _rows(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A round: vectors that have a cluster by balls, those of the first round by all comparisons."""
    for batch in batches:
        x = _rows(batch, centroids.shape[1])
        if "cluster" in batch.schema.names:
            own, dist = by_balls(x, batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), centroids)
        else:
            own, dist = nearest(x, centroids)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own, pa.int32()), pa.array(dist, pa.int64())], ["vec_id", "v", "cluster", "distance"])


ASSIGNED = "vec_id long, v array<int>, cluster int, distance long"


def whole_numbers(c: Column, size: int, scale: int) -> Column:
    """floor(scale * x) of each component; null where there are not ``size`` of them, all finite."""
    fine = (F.size(c) == size) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    exact = lambda x: F.when(F.abs(x) * scale < MOST, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large: squared distances would not fit a long")).cast("int"))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(c, lambda x: exact(x.cast("double"))))


def ball_kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(vec_id, v, cluster, distance of every kept row of ``vectors`` (vec_id, embedding); the final centroids).

    Kept are embeddings of exactly ``size`` components, none null or non-finite; a component x counts as floor(scale * x). A component of
    2^26 / scale or more in size ends the job with its reason, since squared distances would not fit a long. Centroids start as the k
    kept vectors with the least SHA-256 of ``seed:vec_id`` (those without an id last; equal ids in the order of components), so
    equal vectors may start several clusters, of which the first takes all. Fewer than k vectors are as many clusters. Each round assigns
    every vector to the nearest centroid, of equals the one with the smaller number, and moves a centroid that has any vectors to the
    floor of their mean; then all are assigned once more. Repeated rows count as often as they come. No kept vector: no rows.
    """
    with Workspace(vectors.sparkSession) as ws:
        kept = ws.table(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), size, scale).alias("v")).where("v is not null"), "kept")
        drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
        first = kept.select(drawn.alias("drawn"), "v").orderBy(F.asc_nulls_last("drawn"), "v").limit(k).collect()
        if not first:
            return kept.sparkSession.createDataFrame([], ASSIGNED), []
        centroids = [tuple(r.v) for r in first]
        now = kept
        for _ in range(rounds):
            now = _round(ws, now, centroids)
            sums = now.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("v")[j].cast("long")).alias(f"s{j}") for j in range(size)))
            for r in sums.collect():  # k rows
                centroids[r.cluster] = tuple(r[f"s{j}"] // r.n for j in range(size))
        return ws.result(_round(ws, now, centroids, last=True)), centroids


def _round(ws: Workspace, now: DataFrame, centroids: list[tuple[int, ...]], last: bool = False) -> DataFrame:
    c = np.array(centroids, np.int64)
    out = now.mapInArrow(lambda it: _assign(it, c), ASSIGNED)
    return out if last else ws.table(out, "round")


def inertia(assigned: DataFrame, centroids: list[tuple[int, ...]]) -> DataFrame:
    """``assigned`` without its components, with cluster_inertia, inertia and the SHA-256 of the cluster's centroid."""
    of = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    told = [(c, s, sum(of.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in of.items()]
    known = assigned.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

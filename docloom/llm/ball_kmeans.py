"""Centroid clustering by ball k-means on integer vectors.

A cluster is a ball: its centroid and the largest distance of a member. Half the distance between
two centroids tells whether a ball can lose members to the other: only centroids nearer than twice
the radius are neighbours. Members nearer than half the way to the nearest neighbour are the stable
core and stay without a comparison; between them and the border lie annuli, one for each
neighbour in order of its distance, and a member is compared exactly only with the neighbours
whose annulus it reaches. All distances are squared integers, so the bounds are exact and ties,
which go to the smaller number, are met exactly.

A round is one pass: every task takes its part of a cluster as a ball of its own (with a
radius no larger than the whole one's), assigns its vectors, and writes them with their cluster
to the shared folder, where also the sums of its members by cluster stand; these sums, some rows a task,
are added up by Spark, and k centroids go to the driver and back. Nothing is grouped by cluster,
so a cluster of any size, or one vector repeated, is no hot key; the table of a round is deleted
when the next one is written.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left
out; components are floor(scale * x) and are held within 2**26 in size, so that distances fit a long; of
rows with equal seed hashes (repeated ids) the smaller vector is the earlier seed; with fewer
vectors than k there are fewer centroids; an empty table gives an empty result; a null id hashes as an empty
one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, released, written_at

#: Components are held within this size.
LARGEST = 1 << 26
_STATE = "id {0}, v array<int>, cluster int, distance long, n long, inertia long, sums array<long>"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """id, v: the vectors that count, as integers."""
    x = vectors[vector_col]
    whole = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kept = vectors.where(F.coalesce(whole, F.lit(False))).select(vectors[id_col].alias("id"), x.alias("x"))
    held = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(c.cast("double") * scale))).cast("int")
    return kept.select("id", F.transform("x", held).alias("v"))


def seeds(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of the smallest hashes of seed:id; k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    top = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in top], np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def assign(v: np.ndarray, own: np.ndarray | None, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each vector, and the number of exact comparisons.
    own: the cluster of each vector so far; without it vectors are compared with all."""
    if own is None:
        all_d = np.stack([squared(v, c) for c in centroids], axis=1)
        best = all_d.argmin(axis=1)
        return best.astype(np.int32), all_d[np.arange(len(v)), best], all_d.size
    cluster, distance, compared = own.astype(np.int32), np.empty(len(v), np.int64), 0
    for c in np.unique(own):
        members = np.flatnonzero(own == c)
        d = squared(v[members], centroids[c])
        gap = squared(centroids, centroids[c])  # to the other centroids
        gap[c] = np.iinfo(np.int64).max
        best, who = d.copy(), np.full(len(members), c, np.int32)
        neighbours = np.flatnonzero(gap <= 4 * d.max())
        for j in neighbours[np.argsort(gap[neighbours], kind="stable")]:
            reached = np.flatnonzero(4 * d >= gap[j])  # the annulus of j and those outside it
            to = squared(v[members[reached]], centroids[j])
            compared += len(reached)
            nearer = (to < best[reached]) | (to == best[reached]) & (j < who[reached])
            best[reached[nearer]], who[reached[nearer]] = to[nearer], j
        cluster[members], distance[members] = who, best
        compared += len(members)
    return cluster, distance, compared


def _round(centroids: np.ndarray, dims: int, first: bool, id_type: pa.DataType):
    k = len(centroids)

    def rows(ids, v, cluster, distance, n, inertia, sums) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            ids, v, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(n, pa.int64()),
            pa.array(inertia, pa.int64()), pa.array(sums, pa.list_(pa.int64())),
        ], ["id", "v", "cluster", "distance", "n", "inertia", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, inertia = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = batch.column("v")
            v = packed.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
            own = None if first else batch.column("cluster").to_numpy(zero_copy_only=False)
            cluster, distance, _ = assign(v, own, centroids)
            for c in np.unique(cluster):
                mine = cluster == c
                sums[c] += v[mine].sum(axis=0)
                n[c] += mine.sum()
                inertia[c] += distance[mine].sum()
            none = [None] * batch.num_rows
            yield rows(batch.column("id"), packed.cast(pa.list_(pa.int32())), cluster, distance, none, none, none)
        some = np.flatnonzero(n)
        none = [None] * len(some)
        yield rows(pa.nulls(len(some), id_type), pa.nulls(len(some), pa.list_(pa.int32())), some, none, n[some], inertia[some], sums[some].tolist())

    return run


def _sums(state: DataFrame) -> dict[int, tuple[int, int, list[int]]]:
    """Of each cluster that has members: their number, the sum of their distances, and their sums by
    component. As many rows as clusters have components."""
    told = state.where("n is not null").select("cluster", "n", "inertia", "sums")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    whole = told.groupBy("cluster").agg(wide("n"), wide("inertia")).collect()
    each = told.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(wide("x")).orderBy("cluster", "i").collect()
    out: dict[int, tuple[int, int, list[int]]] = {r.cluster: (int(r.n), int(r.inertia), []) for r in whole}
    for r in each:
        out[r.cluster][2].append(int(r.x))
    return out


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid (array<int>) for each vector that counts.
    The centroids, k times dims integers, go to every task."""
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    kind = id_type.simpleString()
    state, path = written_at(quantised(vectors, id_col, vector_col, dims, scale), "vectors")
    centroids = seeds(state, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>")
    arrow_id = state.limit(0).toArrow().schema.field("id").type
    for step in range(rounds + 1):
        work = _round(centroids, dims, step == 0, arrow_id)
        state, done = written_at(map_batches(state if step == 0 else state.where("n is null").select("id", "v", "cluster"), work, _STATE.format(kind)), "clusters")
        released(spark, path)
        path, told = done, _sums(state)
        if step < rounds:
            centroids = centroids.copy()
            for c, (n, _, sums) in told.items():
                centroids[c] = [x // n for x in sums]
    total = sum(t[1] for t in told.values())
    facts = spark.createDataFrame([(c, t[1], total, centroids[c].tolist()) for c, t in told.items()], "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    return state.where("n is null").select("id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: np.ndarray | list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()

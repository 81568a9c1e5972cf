import hashlib
import math
import random

import numpy as np

from docloom.llm import ball_kmeans

SCHEMA = "vec_id long, embedding array<float>, id string, v string, cluster string, n string"


def brute(rows, k, rounds, seed, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cent = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for j in range(len(cent)):
            own = [v for (_, v), m in zip(kept, mine, strict=True) if m == j]
            if own:
                cent[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    return sorted((i if i is not None else -1, j, d, sum(x for _, x, y in out if y == j), sum(x for _, x, _ in out), tuple(cent[j])) for i, d, j in out)


def got(df):
    return sorted((r.id if r.id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect())


def vectors(seed=1, n=150, dims=4):
    rng = random.Random(seed)
    mid = [[rng.gauss(0, 3) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [float(np.float32(rng.gauss(m, 0.4))) for m in mid[i % 5]]) for i in range(n)]
    rows += [(200, [0.5] * dims)] * 40 + [(201 + i, [float(i % 2)] * dims) for i in range(20)]  # repeated rows and ties
    rows += [(300, None), (301, []), (302, [1.0] * (dims + 1)), (303, [None] * dims), (304, [math.nan] * dims), (305, [math.inf] + [0.0] * (dims - 1)), (None, [1.0] * dims)]
    return rows


def test_equals_plain_k_means(spark):
    for seed, k, rounds in ((1, 8, 10), (2, 3, 4), (3, 1, 2)):
        rows = vectors(seed)
        df = spark.createDataFrame([(i, v, "x", "y", "z", "n") for i, v in rows], SCHEMA).repartition(5)
        found = ball_kmeans.clusters(df, k, rounds, "3", 4, 64)
        assert got(found) == brute(rows, k, rounds, "3", 4, 64)


def test_few_and_no_vectors(spark):
    some = spark.createDataFrame([(1, [1.0, 2.0], None, None, None, None), (2, [5.0, 5.0], None, None, None, None)], SCHEMA)
    assert got(ball_kmeans.clusters(some, 8, 3, "3", 2, 2)) == brute([(1, [1.0, 2.0]), (2, [5.0, 5.0])], 8, 3, "3", 2, 2)
    none = ball_kmeans.clusters(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert ball_kmeans.clusters(some, 8, 3, "3", 7).count() == 0
    huge = spark.createDataFrame([(1, [3.0e38, -3.0e38], None, None, None, None), (2, [0.0, 0.0], None, None, None, None)], SCHEMA)
    assert {r.distance for r in ball_kmeans.clusters(huge, 2, 2, "3", 2).collect()} == {0}


def test_balls_assign_as_all_comparisons_do_and_compare_less():
    rng = np.random.default_rng(4)
    cent = rng.integers(-3000, 3000, (20, 16))
    cent[7] = cent[3]  # equal centroids: the smaller number
    v = cent[rng.integers(0, 20, 4000)] + rng.integers(-150, 150, (4000, 16))
    v[:50] = (cent[1] + cent[2]) // 2
    want, want_d, every = ball_kmeans.assign(v, None, cent)
    moved = np.where(rng.random(4000) < 0.02, rng.integers(0, 20, 4000), want)
    for own in (want, moved, np.full(4000, 5)):
        cluster, distance, compared = ball_kmeans.assign(v, own, cent)
        assert (cluster == want).all() and (distance == want_d).all()
    assert ball_kmeans.assign(v, want, cent)[2] < every / 5 and 7 not in want

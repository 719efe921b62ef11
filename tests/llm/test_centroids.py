"""Clustering with a pivot table against plain Lloyd rounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from rollbook.llm import centroids


def lloyd(rows, k, rounds, salt):
    """Rows (vec_id, vector) to (vec_id, cluster, distance, cluster inertia, inertia, digest)."""
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[1]))
    means = [list(v) for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means)) for _, v in rows]

    for _ in range(rounds):
        best = assign()
        for c in range(len(means)):
            own = [v for (_, v), (_, b) in zip(rows, best) if b == c]
            if own:
                means[c] = [sum(x) // len(own) for x in zip(*own)]
    best = assign()
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return [(i, c, d, sum(e for e, b in best if b == c), sum(e for e, _ in best), digest[c]) for (i, _), (d, c) in zip(rows, best)]


RESULT = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def vectors():
    rng = np.random.default_rng(8)
    x = rng.integers(-300, 300, (160, 6))
    x[40:80] = x[3] + rng.integers(-2, 3, (40, 6))
    x[100:130] = x[5]  # ties and repeats
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    return rows + [(7, rows[7][1]), (7, rows[8][1]), (None, [1] * 6), (None, [0] * 6)]


@pytest.mark.parametrize("k,rounds,pivots", [(8, 10, 16), (3, 0, 1), (12, 4, 3)])
def test_cluster(spark, rows, k, rounds, pivots):
    held = vectors()
    df = spark.createDataFrame([(i, v, "x", -1.5) for i, v in held] + [(900, None, "y", 0.0)], "vec_id long, vector array<long>, row string, cluster double").repartition(5)
    got = centroids.cluster(df, k, rounds, "s", pivots)
    assert rows(got, *RESULT) == sorted(lloyd(held, k, rounds, "s"), key=repr)
    assert set(got.columns) == {"row", "vector", *RESULT} and {r.row for r in got.collect()} == {"x"}


def test_few_equal_and_no_vectors(spark, rows):
    df = spark.createDataFrame([(k, [5, -5]) for k in range(3)], "vec_id long, vector array<long>")
    assert rows(centroids.cluster(df), *RESULT) == sorted(lloyd([(k, [5, -5]) for k in range(3)], 8, 10, "3"), key=repr)
    none = centroids.cluster(df.filter("false"))
    assert none.count() == 0 and none.dtypes == centroids.cluster(df).dtypes
    with pytest.raises(Exception, match="2\\*\\*27"):
        centroids.cluster(spark.createDataFrame([(1, [1 << 28])], "vec_id long, vector array<long>"))


def test_bounds_spare_distances_and_change_nothing():
    rng = np.random.default_rng(2)
    middles = rng.integers(-20_000, 20_000, (8, 64))
    x = np.concatenate([m + rng.integers(-300, 300, (500, 64)) for m in middles])
    pivots = centroids.far_apart(x[::40], 16)
    own, least, measured = centroids.nearest(x, centroids.distances(x, pivots), middles, centroids.distances(middles, pivots))
    every = np.stack([centroids.exact(x, m) for m in middles], axis=1)
    assert (own == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    assert measured < 1.2 * len(x)

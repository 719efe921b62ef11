"""Exact k-means of integer vectors with a table of pivot distances.

The distance of every vector to a few fixed pivots is computed once and stored. By the
triangle inequality the difference of two distances to a pivot is a lower bound of the
distance between a vector and a centroid; in every round only centroids whose bound does
not exceed the distance already found get an exact integer distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rollbook import session
from rollbook.llm.prefix import beside, unfold

#: Pivots, and vectors among which they are sought.
PIVOTS = 16
PIVOT_SAMPLE = 1024
#: Largest component, so that squared distances of up to 127 components fit 63 bits.
LARGEST = 1 << 27
#: Components worked on at once.
CHUNK_VALUES = 1 << 20

_SUM = pa.schema([("cluster", pa.int32()), ("pos", pa.int32()), ("total", pa.int64())])


def exact(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared integer distances."""
    apart = x - centroid
    return np.einsum("ij,ij->i", apart, apart)


def far_apart(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots out of a sample, each as far as possible from those before."""
    if not len(sample):
        return sample
    centre = sample.sum(axis=0) // len(sample)
    chosen = [int(exact(sample, centre).argmax())]
    least = exact(sample, sample[chosen[0]])
    while len(chosen) < most and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, exact(sample, sample[chosen[-1]]))
    return sample[chosen]


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distance of every vector to every point."""
    return np.sqrt(np.stack([exact(x, p) for p in points], axis=1).astype(float))


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every vector, its squared distance, and how many distances were computed.

    ``between`` holds the distances of centroids (rows) to pivots. Ties go to the smaller number.
    """
    bound = np.zeros((len(x), len(centroids)))
    for p in range(to_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p: p + 1] - between[:, p]), out=bound)
    # Distances are rounded; a bound gives way by far more than their error.
    bound -= 1e-9 * (1 + to_pivots.max(axis=1, initial=0))[:, None]
    bound = np.square(np.maximum(bound, 0))
    cluster = bound.argmin(axis=1)
    least = np.empty(len(x), np.int64)
    for c in range(len(centroids)):
        own = cluster == c
        least[own] = exact(x[own], centroids[c])
    first, measured = cluster.copy(), len(x)
    for c in range(len(centroids)):
        left = np.flatnonzero((bound[:, c] <= least) & (first != c))
        found = exact(x[left], centroids[c])
        better = (found < least[left]) | ((found == least[left]) & (c < cluster[left]))
        cluster[left[better]], least[left[better]] = c, found[better]
        measured += len(left)
    return cluster, least, measured


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CHUNK_VALUES // max(1, dim))
    for batch in batches:
        for begin in range(0, batch.num_rows, step):
            yield batch.slice(begin, step)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3", pivots: int = PIVOTS) -> DataFrame:
    """Adds cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    ``vectors`` has vec_id (long) and vector (array of integers, all of one length); rows
    with a null vector take no part. Centroids start as the ``k`` vectors of smallest
    sha256 of ``<salt>:<vec_id>`` (null ids last, equal ids by vector); each round assigns
    every vector to its nearest centroid (ties: smaller number) and replaces non-empty
    centroids by the componentwise floor of the mean; empty ones stay. Vectors are then
    assigned once more. Repeated rows are vectors of their own; with fewer than ``k``
    vectors there are as many centroids; an empty table gives no rows. Other columns stay;
    a column named as a result is replaced. Components above 2**27 are an error.

    Centroids, pivots and a round's sums (``k`` times the length) are all that the driver
    holds. Rounds read a stored table, so a lost executor costs its tasks only.
    """
    usable = beside(vectors, vec_id=F.col("vec_id"), vector=F.col("vector").cast("array<long>")).filter("vector is not null")
    order = [F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("vector")]
    seeds = [r.vector for r in usable.select("vec_id", "vector").orderBy(*order).limit(k).collect()]
    added = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
    if not seeds:
        none = usable.filter("false").select("row", *(F.lit(None).cast(t).alias(c) for c, t in added.items()))
        return unfold(none, *added)
    dim, centroids = len(seeds[0]), np.array(seeds, np.int64)
    sampled = usable.select("vector").orderBy(F.xxhash64("vec_id", "vector"), "vector").limit(PIVOT_SAMPLE).collect()
    fixed = far_apart(np.array([r.vector for r in sampled], np.int64), pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, dim):
            x = _matrix(batch.column("vector"), dim)
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError("components of vectors are limited to 2**27")
            table = distances(x, fixed)
            ends = np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vector"), pa.ListArray.from_arrays(ends, table.ravel())], ["row", "vector", "pivots"],
            )

    row = usable.schema["row"].dataType.simpleString()
    measured = usable.select("row", "vector").mapInArrow(measure, f"row {row}, vector array<long>, pivots array<double>")
    stored = session.materialize(measured, "centroid-pivots")

    def sums(centroids: np.ndarray) -> DataFrame:
        between = distances(centroids, fixed)

        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centroids), dim + 1), np.int64)  # the last column counts
            for batch in _slices(batches, dim):
                x = _matrix(batch.column("vector"), dim)
                own, _, _ = nearest(x, _matrix(batch.column("pivots"), len(fixed)), centroids, between)
                for c in np.unique(own):
                    total[c, :dim] += x[own == c].sum(axis=0)
                    total[c, dim] += (own == c).sum()
            c, pos = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((c, pos, total[c, pos]), _SUM.types)], schema=_SUM)

        parts = stored.select("vector", "pivots").mapInArrow(of_task, "cluster int, pos int, total long")
        return parts.groupBy("cluster", "pos").agg(F.sum("total").alias("total"))

    for _ in range(rounds):
        total = np.zeros((len(centroids), dim + 1), np.int64)
        for r in sums(centroids).collect():
            total[r.cluster, r.pos] = r.total
        full = total[:, dim] > 0
        centroids = centroids.copy()
        centroids[full] = total[full, :dim] // total[full, dim:]

    last, between = centroids, distances(centroids, fixed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, dim):
            own, least, _ = nearest(_matrix(batch.column("vector"), dim), _matrix(batch.column("pivots"), len(fixed)), last, between)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(own, pa.int32()), pa.array(least)], ["row", "cluster", "distance"])

    assigned = session.materialize(stored.mapInArrow(assign, f"row {row}, cluster int, distance long"), "centroid-assigned")
    inertia = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    facts = {
        c: (inertia.get(c, 0), hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()) for c, centroid in enumerate(last)
    }

    def fact(at: int) -> Column:
        return F.element_at(F.create_map(*(F.lit(v) for c, f in facts.items() for v in (c, f[at]))), F.col("cluster"))

    out = assigned.withColumns({
        "cluster_inertia": fact(0).cast("long"), "inertia": F.lit(sum(inertia.values())).cast("long"), "centroid_sha256": fact(1),
    })
    return unfold(out, *added)

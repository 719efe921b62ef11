"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollbook import session

#: A node is a hub if it has more than one in this many of all ends of edges.
HUB_SHARE = 512
#: Edges that a task contracts at once.
CHUNK = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reachable from it over the edges given), without the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    leaf = root != np.arange(len(nodes))
    return nodes[leaf], nodes[root[leaf]]


def _contracted(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) as stars of the components of every ``CHUNK`` edges of a partition.

    Components stay as they are, and no chunk leaves more edges than it had.
    """
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield from both(held)
                held = []
        yield from both(held)

    def both(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(u, v)], ["u", "v"])

    return edges.mapInArrow(contract, "u long, v long")


def _with_least(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """``edges`` with the ``m`` of their ``u`` in ``least`` (u, m, n), where u has ``n`` edges.

    Edges of hubs stay where they are and get it from a broadcast table; as ``edges`` has at
    most ``ends`` rows, that holds fewer than ``HUB_SHARE`` nodes. Other edges are joined by
    a shuffle, to which no node brings more than ``ends / HUB_SHARE`` rows.
    """
    hub = F.col("n") > ends // HUB_SHARE
    marked = edges.join(F.broadcast(least.filter(hub).drop("n")), "u", "left")
    others = marked.filter("m is null").drop("m").join(least.filter(~hub).drop("n"), "u")
    return marked.filter("m is not null").unionByName(others)


def _unsettled(edges: DataFrame) -> tuple[int, int]:
    """Edges, and nodes that are neither the middle of a star nor one of its leaves."""
    ends = edges.select(F.col("u").alias("node"), "v").unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
    ends = ends.groupBy("node").agg(F.count("v").alias("up"), F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    both = F.coalesce((F.col("least") < F.col("most")) | ((F.col("up") > 0) & (F.col("up") < F.col("n"))), F.lit(False))
    found = ends.agg(F.sum("up"), F.count_if(both)).first()
    return found[0] or 0, found[1]


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Smallest node reachable from each node: (node, root); nodes without edges are absent.

    ``edges`` has two long columns, ``a`` and ``b``. Tasks first contract the edges that they
    hold; where all are stars then, as in a small table, nothing else is to be done. Else each
    turn links the larger neighbours of every node to its smallest one, then the smaller ones;
    edges become stars after a number of turns that grows with the logarithm of the nodes.
    Only smallest neighbours are aggregated and edges of hubs are not shuffled by node, so a
    node with very many edges is never collected.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = session.materialize(_contracted(edges), "component-edges")
    for _ in range(most):
        held, apart = _unsettled(edges)
        if not apart:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, least, 2 * held).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = session.materialize(large.filter("u <> v").distinct(), "component-half")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, 2 * held).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = session.materialize(_contracted(small), "component-edges")
    else:
        raise RuntimeError("components did not settle")
    out = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Near copies by Jaccard similarity of word shingles, with a tree of count vectors.

Shingles are hashed into groups; the counts of a document's shingles in the groups are a
point, and the sum of coordinate minima of two points bounds the overlap of their sets from
above. A packed R-tree over the points keeps coordinate maxima of its nodes, and descends
only where the bound reaches the overlap that the similarity needs; what is left is
verified on the sets themselves.

One tree over a whole corpus prunes nothing near its root, as the maxima over many
documents exceed any point. Trees are therefore built within clusters: two similar sets
share one of their rarest shingles (an exact prefix filter), and clusters are connected by
such shingles. Documents that cannot have a partner, because too few of their shingles
occur anywhere else, leave before that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from rollbook import session
from rollbook.llm import repeats, words as w
from rollbook.llm.components import components
from rollbook.llm.prefix import SEPARATED, beside, unfold

SHINGLE = 5
#: Sets from this size on publish only hashes of the lower half, which still leaves more
#: than the part that a partner may lack; sets for which it does not publish all.
HALF_FROM = 200
HALF = np.uint64(1 << 63)
#: Coordinates of a point, entries of a tree node.
GROUPS = 128
FANOUT = 16
#: Shingles of the sets that one task compares; a larger cluster is cut into tiles.
TILE_SHINGLES = 4_000_000


def shingle_sets(words: w.Words, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    hashes, counts = words.hashes(), words.counts
    starts = words.windows(size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    grams = w.window_hashes(hashes, starts, starts + size)
    edges = np.searchsorted(starts, words.first)
    out = [np.unique(grams[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    whole = w.window_hashes(hashes, words.first[:-1][short], words.first[1:][short])
    for k, h in zip(short, whole):
        out[k] = np.array([h], dtype=np.uint64)
    return out


class Threshold:
    """Similarity of at least ``percent`` / 100, in integers."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def lacking(self, n: int) -> int:
        """How many elements of a set of ``n`` a partner may lack."""
        return n - -(-self.percent * n // 100)

    def overlap(self, both: np.ndarray) -> np.ndarray:
        """Least overlap of two sets with so many elements together."""
        return -(-self.percent * both // (100 + self.percent))

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= self.percent * (len(a) + len(b) - common)


def published(one: np.ndarray, limit: Threshold) -> tuple[int, int]:
    """How many of the sorted hashes are published, and how many of these lie in the lower half."""
    half = int(np.searchsorted(one, HALF))
    return (len(one) if len(one) < HALF_FROM or half <= limit.lacking(len(one)) else half), half


def prefix(one: np.ndarray, counts: np.ndarray, limit: Threshold) -> list[int] | None:
    """The repeated ones among a set's rarest published shingles; None if it has no partner.

    ``counts`` tells how often each published hash occurs (0: once). A partner lacks at most
    ``limit.lacking`` of the set, so of any part of it; the rarest common shingle is
    therefore among so many plus one of that part, on both sides.
    """
    shown, half = published(one, limit)
    lacking = limit.lacking(len(one))
    chosen: set[int] = set()
    for n in {shown, half}:
        if (counts[:n] >= 2).sum() < n - lacking:
            continue  # more than the part that a partner may lack occurs nowhere else
        rare = np.lexsort((one[:n], counts[:n]))[: lacking + 1]
        chosen.update(one[rare[counts[rare] >= 2]].view(np.int64).tolist())
    return sorted(chosen) or None


class CountTree:
    """Packed R-tree over count vectors; a node keeps maxima of counts and the range of sizes."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray) -> None:
        # Packed by size, then by the coordinate that varies most among those of like size.
        slab = max(FANOUT, int(np.sqrt(len(sizes) * FANOUT)))
        order = np.argsort(sizes, kind="stable")
        wide = points[:, int(points.var(axis=0).argmax())] if len(sizes) else sizes
        order = np.concatenate([part[np.argsort(wide[part], kind="stable")] for part in (order[k: k + slab] for k in range(0, len(order), slab))]) if len(order) else order
        self.order = order
        self.levels = [(points[order], sizes[order], sizes[order])]
        while len(self.levels[-1][0]) > FANOUT:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def search(self, place: int, limit: Threshold) -> np.ndarray:
        """Places after ``place`` (in packed order) whose bound reaches the needed overlap."""
        point, size = self.levels[0][0][place], int(self.levels[0][1][place])
        least, most = -(-limit.percent * size // 100), 100 * size // limit.percent
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            nodes = nodes[(nodes + 1) * FANOUT ** depth > place + 1]
            nodes = nodes[(high[nodes] >= least) & (low[nodes] <= most)]
            bound = np.minimum(top[nodes], point).sum(axis=1)
            nodes = nodes[bound >= limit.overlap(size + np.maximum(low[nodes], least))]
            if depth:
                below = len(self.levels[depth - 1][0])
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < below]
        return nodes[nodes > place]


def count_points(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), GROUPS), dtype=np.int32)
    for k, s in enumerate(sets):
        out[k] = np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return out


def linked_roots(nodes: np.ndarray, sets: list[np.ndarray], limit: Threshold) -> np.ndarray:
    """Smallest node that each is linked with, directly or through others of these sets.

    Pairs that are already connected need no verification.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    tree = CountTree(sizes, count_points(sets))
    order = tree.order
    label = np.arange(len(sets))  # by packed place
    members = {k: [k] for k in range(len(sets))}
    for place in range(len(sets) - 1):
        for other in tree.search(place, limit):
            a, b = int(label[place]), int(label[other])
            if a != b and limit.linked(sets[order[place]], sets[order[other]]):
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                members[a] += members[b]
                label[members.pop(b)] = a
    roots = np.empty(len(sets), dtype=np.int64)
    for group in members.values():
        at = order[group]
        roots[at] = nodes[at].min()
    return roots


def _signature(one: np.ndarray) -> tuple[int, int]:
    return tuple(int(w.mix(one ^ np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, carry: list[str] | None = None, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """One row for each row of ``docs``: the columns ``carry`` (default: ``doc_id``), and
    n_shingles, component_id and ``first``, true for one row of every component.

    Shingles are runs of five words, A-Z lower-cased; a text of fewer words is one shingle,
    one without words (or null) has none and is linked with nothing. Two texts are linked
    when their sets have a Jaccard similarity of at least ``percent`` / 100; component_id is
    the smallest ``doc_id`` reachable over links, and ``first`` marks a row with it. Texts of equal sets are one node of the
    search. A null ``doc_id`` takes part and gets its component's smallest known id, null if
    there is none. Repeated rows are linked. An empty table gives no rows.
    """
    limit = Threshold(percent)
    carry = [doc_id] if carry is None else carry
    slim = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*carry, doc_id, text])))
    rows, buckets = repeats.dealt(slim, text)

    def publish(table: pa.Table) -> pa.Table:
        parts = []
        for words in repeats.each_chunk(*repeats.texts_of(table, text), lower=True):
            parts += [s[: published(s, limit)[0]] for s in shingle_sets(words)]
        return repeats.entries(table.column("block")[0].as_py(), parts, buckets)

    def describe(table: pa.Table, replies: pa.Table) -> pa.Table:
        known = repeats.Known(replies)
        n, low, high, kept, tokens = [], [], [], [], []
        for words in repeats.each_chunk(*repeats.texts_of(table, text), lower=True):
            sets = shingle_sets(words)
            shown = [s[: published(s, limit)[0]] for s in sets]
            counts = known.counts_of(np.concatenate(shown)) if shown else np.zeros(0, np.uint32)
            counts = np.split(counts, np.cumsum([len(s) for s in shown])[:-1])
            for s, c in zip(sets, counts):
                rare = prefix(s, c, limit) if len(s) else None
                a, b = _signature(s) if rare else (None, None)
                n.append(len(s))
                low.append(a)
                high.append(b)
                kept.append(s.tobytes() if rare else None)
                tokens.append(rare)
        ids = pc.struct_field(table.column("row"), doc_id).cast(pa.int64())
        own = {"row": w.fields_of(table.column("row"), carry), "id": ids}
        return pa.table(own | {"n_shingles": pa.array(n, pa.int64()), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64()), "kept": pa.array(kept, pa.binary()), "tokens": pa.array(tokens, pa.list_(pa.int64()))})

    replies = repeats.repeated(rows.groupBy("block").applyInArrow(publish, repeats.ENTRY_SCHEMA))
    kinds = StructType([slim.schema[c] for c in carry]).simpleString()
    schema = f"row {kinds}, id long, n_shingles long, low long, high long, kept binary, tokens array<bigint>"
    described = repeats.by_block(rows, replies, describe, schema).withColumn("at", F.monotonically_increasing_id())
    described = session.materialize(described, "jaccard-sets")

    alone = described.filter("low is null").select("row", "n_shingles", F.col("id").alias("component_id"), F.lit(True).alias("first"))
    several = described.filter("low is not null")
    same = ["n_shingles", "low", "high"]
    least = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "at")).alias("least")
    nodes = several.groupBy(*same).agg(least, F.first("tokens").alias("tokens"))
    nodes = session.materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    roots = _roots(nodes, several.select("at", "kept"), limit, tile_shingles)
    named = nodes.select("node", "least", *same).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least").alias("whole"))
    named = named.join(smallest, "root").select(*same, "whole")
    found = several.select("row", "at", *same).join(named, same)
    found = found.select("row", "n_shingles", F.col("whole.id").alias("component_id"), (F.col("whole.at") == F.col("at")).alias("first"))
    return unfold(alone.unionByName(found), "n_shingles", "component_id", "first")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that :func:`near_copies` marks as first, with all their columns.

    Rows are known by a hash of all columns meanwhile, so texts are moved once more and
    never stored. Rows without words are all kept; of rows equal in all columns one stays.
    """
    keyed = beside(docs).withColumn("digest", F.xxhash64("row"))
    worded = F.coalesce(F.col("row").getField(text).cast("string").rlike(SEPARATED), F.lit(False))
    slim = keyed.select(F.col("row").getField(doc_id).alias("doc_id"), F.col("row").getField(text).alias("text"), "digest")
    marked = near_copies(slim, percent=percent, carry=["doc_id", "digest"])
    first = session.materialize(marked.filter("first and n_shingles > 0").select("digest").distinct(), "jaccard-first")
    kept = keyed.filter(worded).join(first, "digest", "left_semi").dropDuplicates(["digest"])
    return unfold(kept.unionByName(keyed.filter(~worded)))


def _roots(nodes: DataFrame, sets: DataFrame, limit: Threshold, tile_shingles: int) -> DataFrame:
    """(node, root) of all nodes that may have a link; ``sets`` has (at, kept).

    Sets are large: they move once, when it is known which nodes are compared with which.
    """
    tokens = nodes.select("node", F.explode("tokens").alias("token"))
    first = tokens.groupBy("token").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = tokens.join(first, "token").select("a", F.col("node").alias("b"))
    clusters = session.materialize(components(stars), "jaccard-clusters").withColumnRenamed("root", "cluster")
    placed = nodes.select("node", "n_shingles", "least.at").join(clusters, "node")
    sizes = placed.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / tile_shingles).cast("int").alias("tiles"))
    placed = session.materialize(placed.join(sizes, "cluster").drop("n_shingles"), "jaccard-placed")

    def link(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("kept").to_pylist()]
        return pa.table({"a": pa.array(nodes), "b": pa.array(linked_roots(nodes, sets, limit))})

    alone = placed.filter("tiles = 1").join(sets, "at").select("cluster", "node", "kept")
    links = alone.groupBy("cluster").applyInArrow(link, "a long, b long")
    large = placed.filter("tiles > 1").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    if large.isEmpty():
        return components(links)
    large = large.join(sets, "at").drop("at")
    # First every tile with tile 0; after that only tiles of clusters that are still in parts.
    links = session.materialize(links.unionByName(_tiled(large, F.lit(1), link)), "jaccard-links")
    known = components(links)
    state = large.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = state.groupBy("cluster").agg((F.min("root") < F.max("root")).alias("split")).filter("split")
    more = _tiled(large.join(split, "cluster", "left_semi"), F.col("tiles"), link)
    return components(links.unionByName(more))


def _tiled(large: DataFrame, before: Column, link) -> DataFrame:
    """Links within all pairs (i, j) of tiles of a cluster, i < j and i < ``before``."""
    last = F.col("tiles") - 1
    as_first = F.when((F.col("tile") < before) & (F.col("tile") < last), F.transform(F.sequence(F.col("tile") + 1, last), lambda j: F.struct(F.col("tile").alias("i"), j.alias("j"))))
    ends = F.least(F.col("tile"), before) - 1
    as_second = F.when(ends >= 0, F.transform(F.sequence(F.lit(0), ends), lambda i: F.struct(i.alias("i"), F.col("tile").alias("j"))))
    none = F.array().cast("array<struct<i:int,j:int>>")
    pairs = F.concat(F.coalesce(as_first, none), F.coalesce(as_second, none))
    dealt = large.withColumn("pair", F.explode(pairs)).select("cluster", "pair.i", "pair.j", "node", "kept")
    return dealt.groupBy("cluster", "i", "j").applyInArrow(link, "a long, b long")

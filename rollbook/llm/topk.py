"""Exact search for the largest inner products with ball trees, branch and bound.

Vectors are dealt into cells of space by a tree of splits fitted on a bounded sample; every
row is placed, and a cell of more rows than a shard holds is dealt into several shards. A
ball is known by its centre and radius: the inner product of a query with any vector inside
is at most its product with the centre plus the query's norm times the radius. Queries first
visit the cell of the highest bound, which gives each a k-th score; they are then sent only
to those other cells whose bound reaches it. Within a shard the nodes of its ball tree are
opened from the highest bound down, and a node below the current k-th score is cut with all
that lies under it.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollbook import session

#: Vectors of a shard, queries that visit a shard in one task (averages), vectors of a leaf,
#: and splits between a node and those opened with it.
SHARD_ROWS = 16_384
TASK_QUERIES = 8_192
LEAF = 64
STEP = 3
#: Vectors and, on average, components of the sample that cells are fitted on, vectors of it
#: for each cell, and cells of one length of vectors at most.
SAMPLE_ROWS = 16_384
SAMPLE_COMPONENTS = 1 << 22
SAMPLE_OF_CELL = 16
MOST_CELLS = 1_024
#: Queries whose bounds in all cells are computed at once.
_ROUTED = 256


def _axis(x: np.ndarray) -> np.ndarray:
    """The line between two far points."""
    if not len(x):
        return np.zeros(x.shape[1])
    far = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    return far - x[((x - far) ** 2).sum(axis=1).argmax()]


def _cut(along: np.ndarray) -> float:
    """The middle of the widest gap in the middle half, so that groups stay whole."""
    if not len(along):
        return 0.0
    v = np.sort(along)
    v = v[len(v) // 4: len(v) - len(v) // 4]
    at = int(np.diff(v).argmax()) if len(v) > 1 else 0
    return float(v[at] + v[min(at + 1, len(v) - 1)]) / 2


def _centre(x: np.ndarray) -> np.ndarray:
    return x.mean(axis=0) if len(x) else np.zeros(x.shape[1])


def _beyond_rounding(bounds: np.ndarray) -> np.ndarray:
    return bounds + 1e-9 * np.abs(bounds) + 1e-3  # scores are integers


class BallTree:
    """Vectors in tree order, with centres and radii of nodes, level by level."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        order, splits = np.arange(len(ids)), [[(0, len(ids))]]
        while max(b - a for a, b in splits[-1]) > LEAF:
            below = []
            for a, b in splits[-1]:
                part = order[a:b]
                order[a:b] = part[np.argsort(vectors[part] @ _axis(vectors[part]), kind="stable")]
                m = (a + b) // 2
                below += [(a, m), (m, b)]
            splits.append(below)
        self.ids, self.rows, self.vectors, self.leaves = ids[order], rows[order], vectors[order], splits[-1]
        self.depths = [*range(0, len(splits) - 1, STEP), len(splits) - 1]
        self.centres, self.radii = [], []
        for level in (splits[d] for d in self.depths):
            centres = np.stack([_centre(self.vectors[a:b]) for a, b in level])
            self.centres.append(centres)
            self.radii.append(np.array([np.sqrt(((self.vectors[a:b] - c) ** 2).sum(axis=1).max(initial=0.0)) for (a, b), c in zip(level, centres)]))
        self.opened = 0  # leaves read so far

    def search(self, query: np.ndarray, own: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` (ids, scores) of at least ``least``, ties to smaller ids; row ``own`` is left out."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        norm = float(np.sqrt(query @ query))
        waiting = [(-np.inf, 0, 0)]
        while waiting:
            bound, level, node = heapq.heappop(waiting)
            if -bound < least:
                break
            if level < len(self.depths) - 1:
                width = 1 << (self.depths[level + 1] - self.depths[level])
                under = slice(node * width, (node + 1) * width)
                bounds = _beyond_rounding(self.centres[level + 1][under] @ query + norm * self.radii[level + 1][under])
                for below, own_bound in enumerate(np.minimum(bounds, -bound).tolist(), under.start):
                    if own_bound >= least:
                        heapq.heappush(waiting, (-own_bound, level + 1, below))
                continue
            self.opened += 1
            a, b = self.leaves[node]
            found = np.rint(self.vectors[a:b] @ query).astype(np.int64)
            good = (found >= least) & (self.rows[a:b] != own)
            if good.any():
                ids, scores = np.concatenate([ids, self.ids[a:b][good]]), np.concatenate([scores, found[good]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    least = max(least, float(scores[-1]))
        return ids, scores


class Cells:
    """Cells of space for vectors of one length: 2 ** ``depth`` of them.

    ``radii`` must be set from all rows placed; a cell without rows has none and is never
    visited. Cuts are exact for integers, so a row is placed alike whenever it is.
    """

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.axes, self.cuts = [], []
        parts = [sample]
        for _ in range(depth):
            axes = [_axis(p) for p in parts]
            along = [(p * a).sum(axis=1) for p, a in zip(parts, axes)]
            cuts = [_cut(v) for v in along]
            parts = [half for p, v, c in zip(parts, along, cuts) for half in (p[v <= c], p[v > c])]
            self.axes.append(np.stack(axes))
            self.cuts.append(np.array(cuts))
        self.centres = np.stack([_centre(p) for p in parts])
        self.radii = np.full(len(parts), np.nan)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and the distance from its centre."""
        cell = np.zeros(len(x), np.int64)
        for axes, cuts in zip(self.axes, self.cuts):
            cell = 2 * cell + ((x * axes[cell]).sum(axis=1) > cuts[cell])
        return cell, np.sqrt(((x - self.centres[cell]) ** 2).sum(axis=1))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of every query in every cell; of cells without rows, less than any score."""
        norms = np.sqrt((queries ** 2).sum(axis=1))[:, None]
        own = _beyond_rounding(queries @ self.centres.T + norms * self.radii)
        return np.where(np.isnan(self.radii), -np.inf, own)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype=float).reshape(len(values), -1)


def fit_cells(store: DataFrame, shard_rows: int) -> dict[int, Cells]:
    """Cells for each length of vectors of which the sample holds enough; others stay whole.

    The sample is bounded in rows and in components: vectors of more than four times the
    average length are not in it.
    """
    n, held = store.agg(F.count("*"), F.sum("dim")).first()
    if n <= shard_rows:
        return {}
    mean = max(1, held // n)
    take = min(SAMPLE_ROWS, max(1, SAMPLE_COMPONENTS // mean))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "at"), F.lit(n))
    drawn = store.filter((draw < 2 * take) & (F.col("dim") <= 4 * mean)).orderBy(F.xxhash64("at"), "at").limit(take).select("dim", "vector").toPandas()
    out = {}
    for dim, part in drawn.groupby("dim"):
        want = min(MOST_CELLS, n * len(part) / len(drawn) / shard_rows, len(part) / SAMPLE_OF_CELL)
        if want > 1 and dim:
            out[int(dim)] = Cells(_matrix(part["vector"]), int(np.ceil(np.log2(want))))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int, shard_rows: int = SHARD_ROWS, task_queries: int = TASK_QUERIES) -> DataFrame:
    """The ``k`` highest inner products of each query: query_id, rank, vec_id, score.

    ``vectors`` has (vec_id long, vector array of integers). Queries are the rows for which
    ``is_query`` holds; candidates are all other rows of the same length, also those of equal
    ``vec_id``. Rows of empty vectors score 0 with one another.
    Ties go to the smaller ``vec_id``; with fewer candidates, all are returned. Rows with a
    null id or vector, or a null component, take no part. Scores must stay below 2**53.
    Repeated query rows are queries each for itself. An empty table gives no rows.
    """
    usable = vectors.filter("vec_id is not null and vector is not null").filter(F.forall("vector", lambda x: x.isNotNull()))
    store = usable.select("vec_id", "vector", F.size("vector").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("at"))
    store = session.materialize(store, "topk-vectors")
    cells = fit_cells(store, shard_rows)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in pdf.groupby("dim"):
                cell, away = cells[dim].place(_matrix(part["vector"])) if dim in cells else (0, 0.0)
                yield part.assign(cell=cell, away=away)

    kinds = "vec_id long, vector array<bigint>, dim int, at long"
    placed = store.select("vec_id", F.col("vector").cast("array<bigint>").alias("vector"), "dim", "at").mapInPandas(place, f"{kinds}, cell int, away double")
    held = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    held = session.materialize(held.withColumn("parts", F.ceil(F.col("n") / shard_rows).cast("int")), "topk-cells")
    # At most MOST_CELLS rows for each length of vectors that the sample gave cells.
    for row in held.filter(F.col("dim").isin(*cells)).collect() if cells else []:
        cells[row["dim"]].radii[row["cell"]] = row["radius"]
    parts = held.select("dim", "cell", "parts")
    part = F.pmod(F.xxhash64("at"), F.col("parts")).cast("int").alias("part")

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        tree = BallTree(pdf["vec_id"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64), _matrix(pdf["vector"]))
        own = {c: int(pdf[c].iloc[0]) for c in ("dim", "cell", "part")}
        return pd.DataFrame([{**own, "tree": pickle.dumps(tree, protocol=5)}])

    shard = ["dim", "cell", "part"]
    dealt = placed.join(parts, ["dim", "cell"]).select(*shard[:2], part, "at", "vec_id", "vector")
    trees = session.materialize(dealt.groupBy(*shard).applyInPandas(plant, "dim int, cell int, part int, tree binary"), "topk-trees")

    def route(frames: Iterator[pd.DataFrame], nearest: bool) -> Iterator[pd.DataFrame]:
        """Cells that queries go to: that of the highest bound, or all that reach the k-th score."""
        for pdf in frames:
            for dim, group in pdf.groupby("dim"):
                for begin in range(0, len(group), _ROUTED):
                    some = group.iloc[begin: begin + _ROUTED]
                    bounds = cells[dim].bounds(_matrix(some["vector"])) if dim in cells else np.full((len(some), 1), np.inf)
                    if nearest:
                        q, cell = np.arange(len(some)), bounds.argmax(axis=1)
                    else:
                        q, cell = np.nonzero((bounds >= some["least"].to_numpy()[:, None]) & (bounds > -np.inf))
                    yield pd.DataFrame({"at": some["at"].to_numpy()[q], "dim": dim, "cell": cell, "least": some["least"].to_numpy()[q]})

    def routed(asking: DataFrame, nearest: bool) -> DataFrame:
        return asking.select("at", "dim", "vector", "least").mapInPandas(lambda frames: route(frames, nearest), "at long, dim int, cell int, least double").join(parts, ["dim", "cell"])

    def visit(tree_rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(tree_rows) and len(asking):
            tree = pickle.loads(tree_rows["tree"].iloc[0])
            for at, own, x, least in zip(asking["at"], asking["vec_id"], _matrix(asking["vector"]), asking["least"]):
                ids, scores = tree.search(x, at, least, k)
                out += [(at, own, j, s) for j, s in zip(ids, scores)]
        return pd.DataFrame(out, columns=["at", "query_id", "vec_id", "score"]).astype("int64")

    queries = store.filter("asks").select("dim", "at", "vec_id", "vector")

    def searched(pairs: DataFrame, label: str) -> DataFrame:
        """Trees meet the queries sent to them; one copy for each ``task_queries`` of those."""
        pairs = session.materialize(pairs.select(*shard, "at", "least"), f"topk-{label}")
        teams = pairs.groupBy(*shard).agg(F.ceil(F.count("*") / task_queries).cast("int").alias("teams"))
        copies = trees.join(teams, shard).withColumn("team", F.explode(F.sequence(F.lit(0), F.col("teams") - 1))).drop("teams")
        team = F.pmod(F.xxhash64(F.lit("team"), "at"), F.col("teams")).cast("int").alias("team")
        asking = pairs.join(teams, shard).select(*shard, team, "at", "least").join(queries.drop("dim"), "at")
        by = [*shard, "team"]
        return copies.groupBy(*by).cogroup(asking.groupBy(*by)).applyInPandas(visit, "at long, query_id long, vec_id long, score long")

    unknown = queries.withColumn("least", F.lit(float("-inf")))
    home = session.materialize(routed(unknown, True).select(*shard[:2], part, "at", "least"), "topk-home")
    first = session.materialize(searched(home, "first"), "topk-found")
    kth = first.groupBy("at").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") == k).select("at", F.col("kth").cast("double").alias("kth"))
    known = unknown.join(kth, "at", "left").withColumn("least", F.coalesce("kth", "least"))
    rest = routed(known, False).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    rest = rest.join(home.drop("least"), ["at", *shard], "left_anti")
    met = first.unionByName(searched(rest, "rest"))
    order = Window.partitionBy("at", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""Nearest names under edit distance, by an index of letter counts.

Writing one name as another takes at least as many letters as either has more of than the
other. Counts of letters (in 32 groups by code point) and the length of a name are a point;
names are dealt into cells of a tree over these points, and each cell is a tree of its own.
A box around the points of a node gives a lower bound for all its names, so leaves are
visited from the lowest bound up until it exceeds the distance of the best name found.

Counts say little about short names, which are many to a count: those are searched by the
beginnings and endings they share (:mod:`rollbook.operators.name_trie`), in cells so large that
there is rarely more than one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rollbook import session

GROUPS = 32
#: Names of a leaf and of a cell (average), cells at most, names per cell among which cells
#: are cut, names of a cell asked for at once (average), and names asked for by one of at
#: most so many tasks.
LEAF = 32
CELL_NAMES = 8192
MOST_CELLS = 4096
SAMPLE_NAMES = 8
TEAM_NAMES = 512
#: Letters of a name (average) up to which beginnings are searched, and then names of a cell
#: and names of a cell asked for at once: at least, and at most.
SHORT = 24
SHORT_CELL_NAMES = 1 << 21
SHORT_TEAM_NAMES = (1024, 1 << 16)
TASK_NAMES = 1024
MOST_TASKS = 10_000
#: (asked, held) pairs and letters worked on at once, and letters that fit a machine word.
PAIRS = 1 << 19
WORD_PAIRS = 1 << 15
WORD = 64
LETTERS = 1 << 21
#: A distance beyond any.
FAR = np.iinfo(np.int32).max


def letters_of(texts: pa.Array) -> np.ndarray:
    """Code points of texts, one after the other."""
    if not len(texts):
        return np.zeros(0, np.int32)
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[[texts.offset, texts.offset + len(texts)]].tolist()
    letters = bytes(memoryview(texts.buffers()[2] or b"")[slice(*offsets)])
    return np.frombuffer(letters.decode().encode("utf-32-le"), np.int32)


class Names:
    """Letters of some names, one after the other."""

    def __init__(self, names: list[str] | pa.Array) -> None:
        self.names = names
        if isinstance(names, pa.Array):
            self.sizes, self.codes = pc.utf8_length(names).to_numpy(zero_copy_only=False), letters_of(names)
        else:
            self.sizes = np.array([len(x) for x in names], np.int32)
            self.codes = np.frombuffer("".join(names).encode("utf-32-le"), np.int32)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])[:-1]

    def points(self) -> np.ndarray:
        """Letters of every group, and the length."""
        owner = np.repeat(np.arange(len(self.names)), self.sizes)
        counts = np.bincount(owner * GROUPS + self.codes % GROUPS, minlength=len(self.names) * GROUPS)
        return np.column_stack([counts.reshape(-1, GROUPS).astype(np.int32), self.sizes])

    def padded(self, which: np.ndarray, width: int, fill: int) -> np.ndarray:
        at = np.arange(width)
        inside = at < self.sizes[which][:, None]
        out = np.full(inside.shape, fill, np.int32)
        out[inside] = self.codes[(self.begins[which][:, None] + at)[inside]]
        return out


def edit_distances(left: Names, right: Names, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edit distance of every pair, row by row of all their tables at once."""
    out = np.empty(len(i), np.int32)
    order = np.argsort(np.maximum(left.sizes[i], right.sizes[j]), kind="stable")
    begin = 0
    while begin < len(order):
        # Pairs are sorted by length, so the last one tells the width of the others.
        end = begin + max(1, LETTERS // (1 + int(max(left.sizes[i[order[begin]]], right.sizes[j[order[begin]]]))))
        part = order[begin:end]
        widest = 1 + int(max(left.sizes[i[part]].max(), right.sizes[j[part]].max()))
        part = part[: max(1, LETTERS // widest)]
        m, n = left.sizes[i[part]], right.sizes[j[part]]
        a, b = left.padded(i[part], int(m.max()), -1), right.padded(j[part], int(n.max()), -2)
        steps = np.arange(a.shape[1] + 1, dtype=np.int32)
        row = np.repeat(steps[None, :], len(part), axis=0)
        out[part[n == 0]] = m[n == 0]
        for k in range(b.shape[1]):
            below = np.empty_like(row)
            below[:, 0] = k + 1
            np.minimum(row[:, 1:] + 1, row[:, :-1] + (a != b[:, k: k + 1]), out=below[:, 1:])
            # Letters inserted one after the other: a running minimum along the row.
            below -= steps
            np.minimum.accumulate(below, axis=1, out=below)
            below += steps
            row = below
            ended = np.flatnonzero(n == k + 1)
            out[part[ended]] = row[ended, m[ended]]
        begin += len(part)
    return out


class Words:
    """Edit distances of names of at most 64 letters to the names of a tree.

    A column of the table of distances is kept as two words of bits, the steps up and down
    from one letter of the asked name to the next; a letter of the other name moves on by a
    whole column at once.
    """

    def __init__(self, asked: Names, alphabet: np.ndarray, ids: np.ndarray, held: Names) -> None:
        self.asked, self.ids, self.held = asked, ids, held
        self.letters = len(alphabet)
        #: Words of as many bits as the asked names have letters.
        self.kind = np.uint32 if asked.sizes.max(initial=0) <= 32 else np.uint64
        self.where = np.zeros((len(asked.names), self.letters), self.kind)
        for k in range(int(asked.sizes.max(initial=0))):
            own = np.flatnonzero(asked.sizes > k)
            code = asked.codes[asked.begins[own] + k]
            at = np.minimum(np.searchsorted(alphabet, code), max(0, self.letters - 1))
            same = alphabet[at] == code if self.letters else np.zeros(len(own), dtype=bool)
            self.where[own[same], at[same]] |= self.kind(1 << k)

    def distances(self, q: np.ndarray, name: np.ndarray) -> np.ndarray:
        out = np.empty(len(q), np.int32)
        for begin in range(0, len(q), WORD_PAIRS):
            part = slice(begin, begin + WORD_PAIRS)
            out[part] = self._part(q[part], name[part])
        return out

    def _part(self, q: np.ndarray, name: np.ndarray) -> np.ndarray:
        # Longest first, so that those with a letter left are always the first ones.
        order = np.argsort(-self.held.sizes[name], kind="stable")
        q, name = q[order], name[order]
        size, begin, row = self.held.sizes[name], self.held.begins[name], q * self.letters
        signed = np.int32 if self.kind is np.uint32 else np.int64
        score = self.asked.sizes[q].astype(signed)
        last = (score - 1).astype(self.kind)
        up, down = np.full(len(q), np.iinfo(self.kind).max, self.kind), np.zeros(len(q), self.kind)
        one, where = self.kind(1), self.where.ravel()
        for k in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -k, side="left"))
            u, d = up[:n], down[:n]
            same = where[row[:n] + self.ids[begin[:n] + k]]
            vertical = same | d
            across = (((same & u) + u) ^ u) | same
            more, less = d | ~(across | u), u & across
            score[:n] += ((more >> last[:n]) & one).view(signed) - ((less >> last[:n]) & one).view(signed)
            more, less = (more << one) | one, less << one
            up[:n], down[:n] = less | ~(vertical | more), more & vertical
        out = np.empty(len(q), np.int32)
        out[order] = score
        return out


def bounds(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least possible distance of each point (rows) to names in each box (columns)."""
    over = np.zeros((len(points), len(low)), np.int32)
    under = np.zeros_like(over)
    for k in range(GROUPS):
        own = points[:, k: k + 1]
        over += np.maximum(own - high[:, k], 0)
        under += np.maximum(low[:, k] - own, 0)
    size = points[:, GROUPS:]
    return np.maximum(np.maximum(over, under), np.maximum(size - high[:, GROUPS], low[:, GROUPS] - size))


def split(points: np.ndarray) -> int:
    """The coordinate that tells points apart best."""
    return int(points.var(axis=0).argmax()) if len(points) else GROUPS


class NameTree:
    """Names by leaves, each a box around their points. Leaves halve at medians."""

    def __init__(self, names: list[str] | pa.Array) -> None:
        names = names.to_pylist() if isinstance(names, pa.Array) else names
        self.rank = np.argsort(np.argsort(np.array(names, dtype=object), kind="stable"))
        self.held = Names(names)
        self.points = self.held.points()
        self.alphabet, self.ids = np.unique(self.held.codes, return_inverse=True)
        order, todo, self.leaves = np.arange(len(names)), [(0, len(names))], []
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                self.leaves.append((a, b))
                continue
            part = order[a:b]
            order[a:b] = part[np.argsort(self.points[part][:, split(self.points[part])], kind="stable")]
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        self.order = order
        begins = np.array([a for a, _ in self.leaves])
        self.begins, self.sizes = begins, np.array([b - a for a, b in self.leaves])
        self.low = np.minimum.reduceat(self.points[order], begins)
        self.high = np.maximum.reduceat(self.points[order], begins)
        #: Leaves looked into and distances computed so far.
        self.visited = self.measured = 0

    def nearest(self, asked: list[str] | pa.Array, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and number of each asked name's nearest, -1 where none is within its limit.

        Among equally near names the first in order is taken.
        """
        asked = asked.to_pylist() if isinstance(asked, pa.Array) else asked
        far, which = limits.astype(np.int64), np.full(len(asked), -1)
        block = max(1, PAIRS // len(self.order))
        sizes = np.array([len(x) for x in asked])
        fits = (sizes > 0) & (sizes <= WORD)
        for some in (np.flatnonzero(fits), np.flatnonzero(~fits)):
            for begin in range(0, len(some), block):
                own = some[begin: begin + block]
                f, w = far[own], which[own]
                self._block(Names([asked[k] for k in own]), f, w)
                far[own], which[own] = f, w
        return far, which

    def _block(self, asked: Names, far: np.ndarray, which: np.ndarray) -> None:
        points = asked.points()
        fits = bool(((asked.sizes > 0) & (asked.sizes <= WORD)).all())
        words = Words(asked, self.alphabet, self.ids, self.held) if fits else None
        least = bounds(points, self.low, self.high)
        leaves = np.argsort(least, axis=1, kind="stable")
        active, at, step = np.arange(len(points)), 0, 8
        while len(active):
            active = active[least[active, leaves[active, at]] <= far[active]]
            near = leaves[active, at: at + step]
            q, leaf = np.repeat(active, near.shape[1]), near.ravel()
            good = least[q, leaf] <= far[q]
            q, leaf = q[good], leaf[good]
            self.visited += len(leaf)
            size = self.sizes[leaf]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            q, name = np.repeat(q, size), self.order[np.repeat(self.begins[leaf], size) + within]
            more = points[q] - self.points[name]
            bag = np.maximum(np.maximum(more[:, :GROUPS], 0).sum(axis=1), np.maximum(-more[:, :GROUPS], 0).sum(axis=1))
            # The likeliest name of each goes first; its distance spares most others.
            order = np.lexsort((bag, q))
            first = np.zeros(len(order), dtype=bool)
            first[order[np.concatenate([[True], q[order][1:] != q[order][:-1]])[: len(order)]]] = True
            for turn in (first, ~first):
                close = turn & (bag <= far[q])
                if close.any():
                    self._measure(asked, words, q[close], name[close], far, which)
            at, step = at + step, 2 * step
            active = active[:0] if at >= len(self.leaves) else active


    def _measure(self, asked: Names, words: Words | None, q: np.ndarray, name: np.ndarray, far: np.ndarray, which: np.ndarray) -> None:
        d = words.distances(q, name) if words else edit_distances(asked, self.held, q, name)
        self.measured += len(q)
        first = np.lexsort((self.rank[name], d, q))
        first = first[np.concatenate([[True], q[first[1:]] != q[first[:-1]]])]
        q, name, d = q[first], name[first], d[first]
        before = np.where(which[q] >= 0, self.rank[which[q]], len(self.rank))
        better = (d < far[q]) | ((d == far[q]) & (self.rank[name] < before))
        far[q[better]], which[q[better]] = d[better], name[better]


def cut(points: np.ndarray, cells: int) -> list[tuple[int, int, int, int]]:
    """A tree that deals points to cells: (coordinate, most on the left, left, right).

    A negative branch is the cell ``-1 - branch``.
    """
    nodes: list = []

    def grow(part: np.ndarray, parts: int, first: int) -> int:
        if parts == 1:
            return -1 - first
        at, left = split(part), parts // 2
        most = int(np.sort(part[:, at])[max(0, len(part) * left // parts - 1)]) if len(part) else 0
        nodes.append(None)
        place, low = len(nodes) - 1, part[:, at] <= most
        nodes[place] = (at, most, grow(part[low], left, first), grow(part[~low], parts - left, first + left))
        return place

    grow(points, cells, 0)
    return nodes


def cells_of(points: np.ndarray, nodes: list[tuple[int, int, int, int]]) -> np.ndarray:
    at = np.full(len(points), 0 if nodes else -1)
    table = np.array(nodes or [(0, 0, -1, -1)])
    inner = np.flatnonzero(at >= 0)
    while len(inner):
        node = table[at[inner]]
        at[inner] = np.where(points[inner, node[:, 0]] <= node[:, 1], node[:, 2], node[:, 3])
        inner = inner[at[inner] >= 0]
    return -1 - at


def nearest(
    asked: DataFrame, offered: DataFrame, most: int | None = None, cell_names: int | None = None,
    team_names: int = TEAM_NAMES, short: int = SHORT,
) -> DataFrame:
    """The nearest offered name of every asked name in the same group: (g, n, d, m, p).

    ``asked`` has distinct (g, n), ``offered`` distinct (g, m) with a payload p, all without
    nulls in g, n and m. Names without one within ``most`` letters are left out. Of equally
    near names the first by code points is taken.

    Every asked name first meets the cell that its own letters belong to; the distance found
    there excludes most other cells by their boxes, and it is sent to the rest only. There
    are at most ``MOST_CELLS`` cells, so their boxes are a small table. A cell that many names
    ask is copied to several tasks. Where offered names have at most ``short`` letters on
    average, cells are searched by beginnings, and are larger.
    """
    offered = session.materialize(offered.select("g", "m", "p"), "names-offered")
    groups = offered.groupBy("g").agg(F.count("*").alias("names"), F.sum(F.length("m")).alias("letters"))
    count, largest, letters = groups.agg(F.sum("names"), F.max("names"), F.sum("letters")).first()
    by_beginnings = (letters or 0) <= short * (count or 0)
    # A cell of beginnings and endings is searched as fast whether it holds few or many names.
    count = (largest if by_beginnings else count) or 0
    cell_names = cell_names or (SHORT_CELL_NAMES if by_beginnings else CELL_NAMES)
    cells = min(MOST_CELLS, max(1, -(-count // cell_names)))
    nodes: list = []
    if cells > 1:
        sample = offered.select("m").orderBy(F.xxhash64("m"), "m").limit(SAMPLE_NAMES * cells).collect()
        nodes = cut(Names([r.m for r in sample]).points(), cells)

    def placed(df: DataFrame, name: str) -> DataFrame:
        if not nodes:
            return df.withColumn("cell", F.lit(0))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = Names(batch.column(name).to_pylist()).points()
                yield batch.append_column("cell", pa.array(cells_of(points, nodes), pa.int32())) if batch.num_rows else batch.append_column("cell", pa.array([], pa.int32()))

        return df.mapInArrow(place, f"{_fields(df)}, cell int")

    limit = FAR if most is None else most
    held = session.materialize(placed(offered, "m"), "names-cells") if nodes else placed(offered, "m")
    home = session.materialize(placed(asked.select("g", "n"), "n").withColumn("limit", F.lit(limit)), "names-asked")
    searched = _searched_by_beginnings if by_beginnings else partial(_searched, team_names=team_names)
    found = searched(home, held)
    if not nodes:
        return found
    found = session.materialize(found, "names-home")
    points = _point_columns(held)
    boxes = points.groupBy("cell").agg(*(f(f"c{k}").alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k in range(GROUPS + 1))).orderBy("cell").collect()
    numbers = np.array([r.cell for r in boxes], np.int32)
    low, high = (np.array([[r[f"{f}{k}"] for k in range(GROUPS + 1)] for r in boxes], np.int32) for f in ("min", "max"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                limits, own = part.column("limit").to_numpy(), part.column("cell").to_numpy()
                least = bounds(Names(part.column("n").to_pylist()).points(), low, high)
                q, c = np.nonzero((least <= limits[:, None]) & (numbers != own[:, None]))
                sent = part.select(["g", "n", "limit"]).take(pa.array(q))
                yield sent.append_column("cell", pa.array(numbers[c], pa.int32()))

    known = home.join(found.select("g", "n", "d"), ["g", "n"], "left").withColumn("limit", F.coalesce("d", "limit")).drop("d")
    elsewhere = known.select("g", "n", "limit", "cell").mapInArrow(send, f"{_fields(known.select('g', 'n', 'limit'))}, cell int")
    elsewhere = session.materialize(elsewhere, "names-elsewhere")
    both = found.unionByName(searched(elsewhere, held))
    return both.groupBy("g", "n").agg(F.min(F.struct("d", "m", "p")).alias("b")).select("g", "n", "b.*")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _point_columns(held: DataFrame) -> DataFrame:
    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = Names(batch.column("m").to_pylist()).points()
            yield pa.RecordBatch.from_arrays([batch.column("cell"), *(pa.array(of[:, k]) for k in range(GROUPS + 1))], ["cell", *(f"c{k}" for k in range(GROUPS + 1))])

    return held.select("m", "cell").mapInArrow(points, "cell int, " + ", ".join(f"c{k} int" for k in range(GROUPS + 1)))


def _searched(asked: DataFrame, held: DataFrame, team_names: int) -> DataFrame:
    """Each cell's names meet the names sent to it, so many of them to a task."""
    # The work follows the names asked for, not their bytes, so the number of tasks is given.
    tasks = min(MOST_TASKS, max(1, -(-asked.count() // TASK_NAMES)))
    return _visited(asked, held, team_names, tasks, NameTree)


def _searched_by_beginnings(asked: DataFrame, held: DataFrame) -> DataFrame:
    """The same, for the index of beginnings, which is larger and takes longer to build."""
    from rollbook.operators.name_trie import NameTrie  # which needs this module

    least, most = SHORT_TEAM_NAMES
    count = asked.count()
    team_names = min(most, max(least, count // (4 * asked.sparkSession.sparkContext.defaultParallelism)))
    # More tasks than teams, as teams are dealt to them by a hash.
    tasks = min(MOST_TASKS, max(1, -(-4 * count // team_names)))
    return _visited(asked, held, team_names, tasks, NameTrie)


def _visited(asked: DataFrame, held: DataFrame, team_names: int, tasks: int, index: type) -> DataFrame:
    teams = asked.groupBy("g", "cell").agg(F.ceil(F.count("*") / team_names).cast("int").alias("teams"))
    team = F.pmod(F.xxhash64("n"), F.col("teams")).cast("int")
    dealt = asked.join(teams, ["g", "cell"]).withColumn("team", team).drop("teams")
    # Groups may be few: without this a task or two would write the copies of all names.
    spread = held.join(teams, ["g", "cell"]).repartition(min(tasks, 4 * asked.sparkSession.sparkContext.defaultParallelism), "m")
    copied = spread.withColumn("team", F.explode(F.sequence(F.lit(0), F.col("teams") - 1))).drop("teams")
    keys = ["g", "cell", "team"]
    copied, dealt = copied.repartition(tasks, *keys), dealt.repartition(tasks, *keys)

    def visit(names: pa.Table, wanted: pa.Table) -> pa.Table:
        if len(names) and len(wanted):
            tree = index(names.column("m").combine_chunks())
            far, which = tree.nearest(wanted.column("n").combine_chunks(), wanted.column("limit").to_numpy())
        else:
            far, which = np.zeros(0, np.int64), np.full(len(wanted), -1)
        ok = np.flatnonzero(which >= 0)
        one, other = wanted.select(["g", "n"]).take(pa.array(ok)), names.select(["m", "p"]).take(pa.array(which[ok]))
        return pa.table({"g": one.column("g"), "n": one.column("n"), "d": pa.array(far[ok], pa.int32()), "m": other.column("m"), "p": other.column("p")})

    kinds = {f.name: f.dataType.simpleString() for f in copied.schema}
    return copied.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(visit, f"g {kinds['g']}, n string, d int, m string, p {kinds['p']}")

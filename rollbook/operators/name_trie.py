"""Nearest names under edit distance, by beginnings and endings that names share.

Names are cut into a beginning and an ending, of which there are far fewer than names. The
distance to a name is the least sum, over all places where the asked name can be cut, of the
distances of its two parts to the beginning and to the ending. Beginnings are a tree, and so are
endings read backwards.

Near names are found by walks of the trees for distances 0, 1, 2 and so on, each leaving the
branches that hold nothing near enough: endings within half of the distance tell which beginnings
can matter, those tell which endings can, and only names that join one of each are compared.
Where no name is near, nearly all branches are walked; then all parts are measured, whatever the
distance, and names compared in the order of the least distance that their parts allow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rollbook.operators.names import WORD, Names, Words, edit_distances, letters_of

#: Different endings at most, and names by which the place of the cut is chosen.
TAILS = 1 << 17
SAMPLED = 1 << 16
#: Distances below this are found by walks.
SEEDS = 4
#: Names walked for at once at most, fewer where more parts than these would be kept for them;
#: (asked name, node) places of a walk at once, and so few of them that all are followed.
BLOCK = 4096
KEPT = 1 << 19
PLACES = 1 << 17
BRANCH = 8
#: Bytes of all parts' least distances for names measured at once, and of columns worked on.
MEASURED = 1 << 25
COLUMNS = 1 << 20
#: Names compared at once, and (asked name, part) entries of the table by which they are found.
COMPARED = 1 << 18
TABLE = 1 << 21


class Beginnings:
    """A tree of distinct texts in order. Nodes are numbered level by level, children in a row."""

    def __init__(self, texts: pa.Array) -> None:
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        codes, begins = letters_of(texts), np.cumsum(sizes) - sizes
        node, some = np.zeros(len(sizes), np.int64), np.flatnonzero(sizes)
        letters, parents, size = [np.zeros(1, np.int32)], [np.zeros(1, np.int64)], 1
        while len(some):
            letter, above = codes[begins[some] + len(letters) - 1], node[some]
            new = np.concatenate([[True], (letter[1:] != letter[:-1]) | (above[1:] != above[:-1])])
            node[some] = size - 1 + np.cumsum(new)
            letters.append(letter[new])
            parents.append(above[new])
            size += int(new.sum())
            some = some[sizes[some] >= len(letters)]
        self.letter = np.concatenate(letters)
        self.alphabet, ids = np.unique(self.letter[1:], return_inverse=True)
        self.ids = np.concatenate([[0], ids])
        self.children = np.bincount(np.concatenate(parents)[1:], minlength=size)
        self.child = 1 + np.cumsum(self.children) - self.children
        #: The text that ends at a node, or -1.
        self.text = np.full(size, -1)
        self.text[node] = np.arange(len(sizes))

    def near(
        self, codes: np.ndarray, limits: np.ndarray, beyond: int, most: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Texts near enough to the first letters of asked names: (asked name, text, distances).

        ``codes`` has a column of letters for each name, ``limits`` a row for each number of
        first letters: how far a text may be from them, or -1. So have the distances; those
        over all limits may be given as more than they are, up to ``beyond``. None if texts are
        more than ``most``.
        """
        m, width, kind = len(codes), max(0, int(limits.max())), limits.dtype
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((m + 1, 0), kind))]
        kept = 0
        # Distances only grow on the way to a text, where the limit of more letters holds.
        ahead = np.maximum.accumulate(limits[::-1])[::-1]
        q = np.flatnonzero(ahead[0] >= 0)
        # Row k of a column is for k - width first letters more than the depth of the node.
        steps = np.arange(-width, width + 2)
        column = np.where((steps < 0) | (steps > width), beyond, steps).astype(kind)
        todo = [(0, q, np.zeros(len(q), np.int64), np.repeat(column[:, None], len(q), axis=1), False)]
        while todo:
            depth, q, node, column, seen = todo.pop()
            low, high, shift = max(0, depth - width), min(m, depth + width), width - depth
            if not seen:
                text = self.text.take(node)
                ends = np.flatnonzero(text >= 0)
                ends = ends[_inside(column.take(ends, axis=1), limits, q.take(ends), low, high, shift)]
                if len(ends):
                    whole = np.full((m + 1, len(ends)), beyond, kind)
                    whole[low: high + 1] = column[low + shift: high + 1 + shift].take(ends, axis=1)
                    found.append((q.take(ends), text.take(ends), whole))
                    kept += len(ends)
                    if kept > most:
                        return None
                inner = np.flatnonzero(self.children.take(node))
                if len(inner) > BRANCH:
                    inner = inner[_inside(column.take(inner, axis=1), ahead, q.take(inner), low, high, shift)]
                q, node, column = q.take(inner), node.take(inner), column.take(inner, axis=1)
            count = self.children.take(node)
            size = int(count.sum())
            if size > PLACES and len(q) > 1:
                half = len(q) // 2
                todo += [(depth, q[part], node[part], column[:, part], True) for part in (slice(half, None), slice(half))]
            elif size and depth < m + width:
                parent = np.repeat(np.arange(len(q)), count)
                below = np.arange(size) + np.repeat(self.child.take(node) - np.cumsum(count) + count, count)
                q = q.take(parent)
                column = _column(depth + 1, column, parent, q, self.letter.take(below), codes, width, beyond)
                todo.append((depth + 1, q, below, column, False))
        q, text, whole = (np.concatenate(x, axis=-1) for x in zip(*found))
        order = np.argsort(q, kind="stable")
        return q.take(order), text.take(order), whole.take(order, axis=1)

    def columns(self, codes: np.ndarray, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Distances of all texts to the first letters of asked names: (depth, texts, distances).

        Distances are given less the depth and the number of first letters: letters of one side
        alone then cost nothing, and a running minimum counts them.
        """
        m, n = codes.shape
        gain = 1 + (codes[:, None] == self.alphabet[:, None]).astype(kind)
        step = max(1, COLUMNS // ((m + 1) * n * np.dtype(kind).itemsize))
        todo = [(0, 0, 1, np.zeros((m + 1, 1, n), kind), None)]
        while todo:
            depth, begin, end, column, parent = todo.pop()
            if depth:
                above, column = column, np.empty((m + 1, end - begin, n), kind)
                before = column[0] = above[0].take(parent, axis=0)
                letter = self.ids[begin: end]
                for i in range(1, m + 1):
                    row, beside = column[i], above[i].take(parent, axis=0)
                    np.subtract(before, gain[i - 1].take(letter, axis=0), row)
                    np.minimum(row, beside, row)
                    np.minimum(row, column[i - 1], row)
                    before = beside
            text = self.text[begin: end]
            ends = np.flatnonzero(text >= 0)
            if len(ends):
                yield depth, text[ends], column if len(ends) == len(text) else column.take(ends, axis=1)
            parent = np.repeat(np.arange(end - begin), self.children[begin: end])
            first = int(self.child[begin])
            for a in range(0, len(parent), step):
                b = min(a + step, len(parent))
                todo.append((depth + 1, first + a, first + b, column, parent[a: b]))


def _inside(column: np.ndarray, limits: np.ndarray, q: np.ndarray, low: int, high: int, shift: int) -> np.ndarray:
    ok = np.zeros(len(q), dtype=bool)
    for i in range(low, high + 1):
        ok |= column[i + shift] <= limits[i].take(q)
    return ok


def _column(
    depth: int, above: np.ndarray, parent: np.ndarray, q: np.ndarray, letter: np.ndarray, codes: np.ndarray, width: int, beyond: int
) -> np.ndarray:
    """Distances one letter further, from those of the nodes above."""
    out = np.full((len(above), len(parent)), beyond, above.dtype)
    low, high = max(0, depth - width), min(len(codes), depth + width)
    before = above[low + width - depth].take(parent)
    for i in range(low, high + 1):
        k = i + width - depth
        row, beside = out[k], above[k + 1].take(parent)
        np.add(beside, 1, row)
        if i:
            before += codes[i - 1].take(q) != letter
            np.minimum(row, before, row)
        if k:
            np.minimum(row, out[k - 1] + 1, row)
        np.minimum(row, beyond, row)
        before = beside
    return out


class Parts:
    """Distinct beginnings, or endings read backwards, and the names of each."""

    def __init__(self, texts: pa.Array, backward: bool) -> None:
        coded = texts.dictionary_encode()
        parts = pc.utf8_reverse(coded.dictionary) if backward else coded.dictionary
        order = pc.array_sort_indices(parts)
        place = np.empty(len(parts), np.int32)
        place[order.to_numpy()] = np.arange(len(parts))
        self.tree = Beginnings(parts.take(order))
        #: The part of each name, names by part, and where those of a part begin.
        self.of = place.take(coded.indices.to_numpy())
        self.names = np.argsort(self.of, kind="stable").astype(np.int32)
        self.count = np.bincount(self.of, minlength=len(parts))
        self.begin = np.cumsum(self.count) - self.count
        #: The other part of those names.
        self.joined = np.zeros(0, np.int32)


class NameTrie:
    """Names by their beginnings and endings."""

    def __init__(self, names: list[str] | pa.Array) -> None:
        self.names = names = pa.array(names, pa.string()) if isinstance(names, list) else names
        #: Names compared so far.
        self.measured = 0
        if not len(names):
            return
        sizes = pc.min_max(pc.utf8_length(names)).as_py()
        self.shortest, self.longest = sizes["min"], sizes["max"]
        place = self._place()
        self.parts = Parts(_cut(names, place)[0], False), Parts(_cut(names, place)[1], True)
        for mine, other in (self.parts, self.parts[::-1]):
            mine.joined = other.of.take(mine.names)
        for part in self.parts:
            part.of = None
        self.alphabet = np.union1d(self.parts[0].tree.alphabet, self.parts[1].tree.alphabet)
        self.lookup = np.zeros(1 + int(self.alphabet.max(initial=0)), np.int32)
        self.lookup[self.alphabet] = np.arange(len(self.alphabet))

    def _place(self) -> int:
        """Letters of a beginning, or less than 0 those of an ending, that make the fewest parts."""
        sample = self.names.take(pa.array(np.arange(0, len(self.names), -(-len(self.names) // SAMPLED))))
        best = (len(sample.unique()) + 1, self.longest)
        for sign in (1, -1):
            for letters in range(1, self.longest):
                heads, tails = (len(x.unique()) for x in _cut(sample, sign * letters))
                if tails <= TAILS:
                    best = min(best, (heads + tails, sign * letters))
                # The part of so many letters only becomes more diverse.
                if (heads if sign > 0 else tails) > best[0]:
                    break
        return best[1]

    def nearest(self, asked: list[str] | pa.Array, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and number of each asked name's nearest, -1 where none is within its limit.

        Among equally near names the first in order is taken.
        """
        far, which = limits.astype(np.int64), np.full(len(asked), -1)
        if not len(self.names) or not len(asked):
            return far, which
        asked = pa.array(asked, pa.string()) if isinstance(asked, list) else asked
        sizes = pc.utf8_length(asked).to_numpy(zero_copy_only=False)
        order = np.argsort(sizes, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            m, f, w = int(sizes[some[0]]), far[some], which[some]
            self._of_one_length(asked.take(pa.array(some)), m, f, w)
            far[some], which[some] = f, w
        return far, which

    def _of_one_length(self, asked: pa.Array, m: int, far: np.ndarray, which: np.ndarray) -> None:
        k, block = max(0, self.shortest - m, m - self.longest), BLOCK
        rest = np.flatnonzero(far >= k)
        while k < SEEDS and len(rest):
            begin = 0
            while begin < len(rest):
                part = rest[begin: begin + block]
                found = self._within(Asked(self, asked.take(pa.array(part)), m), k)
                if found is None:
                    block = -(-len(part) // 2)
                    continue
                q, name, d = found
                far[part[q]], which[part[q]] = d, name
                begin += block
            rest = rest[(which[rest] < 0) & (far[rest] > k)]
            k += 1
        kind = next(x for x in (np.int8, np.int16, np.int32) if 3 * (m + self.longest) < np.iinfo(x).max)
        row = 4 * sum(len(x.count) for x in self.parts) * np.dtype(kind).itemsize
        block = min(BLOCK, max(1, MEASURED // row))
        for begin in range(0, len(rest), block):
            part = rest[begin: begin + block]
            q, name, d = self._beyond(Asked(self, asked.take(pa.array(part)), m), k, far[part], kind)
            far[part[q]], which[part[q]] = d, name

    def _within(self, asked: Asked, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Nearest names within ``k`` letters; None if names are asked for too many at once."""
        n, kept = len(asked.names.sizes), KEPT if len(asked.names.sizes) > 1 else len(self.names)
        shape = asked.codes[0].shape
        half = np.full((shape[0] + 1, n), k // 2, np.int8)
        # The smaller tree is walked twice.
        one = int(len(self.parts[0].tree.letter) > len(self.parts[1].tree.letter))
        found: list = [None, None]
        limits = half
        for side in (one, 1 - one, one):
            found[side] = self.parts[side].tree.near(asked.codes[side], limits, k + 1, kept)
            if found[side] is None:
                return None
            # A part further than its limit is at least so much further, or matters no more.
            least = _least(found[side], half + np.int8(1) if limits is half else np.full_like(half, k + 1))
            limits = (np.int8(k) - least)[::-1]
        names = [np.bincount(x[0], part.count[x[1]], n) for x, part in zip(found, self.parts)]
        fewer = np.where(names[0] <= names[1], 0, 1)
        fewer[(names[0] == 0) | (names[1] == 0)] = 2
        hits: list = []
        for side in (0, 1):
            q, part, _ = found[side]
            other = found[1 - side]

            def inside(own: np.ndarray) -> np.ndarray:
                out = np.zeros((len(own), len(self.parts[1 - side].count)), dtype=bool)
                some = slice(*np.searchsorted(other[0], [own[0], own[-1] + 1]))
                at = np.searchsorted(own, other[0][some])
                good = own[at] == other[0][some]
                out[at[good], other[1][some][good]] = True
                return out

            chosen = fewer[q] == side
            self._join(side, q[chosen], part[chosen], inside, np.full(n, k), asked, hits)
        return self._first(hits)

    def _beyond(self, asked: Asked, k: int, limits: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest names, not nearer than ``k`` letters, within limits."""
        m, n = asked.codes[0].shape
        steps = np.arange(m + 1, dtype=kind)[:, None]
        least = []
        for part, codes in zip(self.parts, asked.codes):
            out = np.full((m + 1, n), np.iinfo(kind).max, kind)
            for depth, _, column in part.tree.columns(codes, kind):
                np.minimum(out, column.min(axis=1) + steps + kind(depth), out)
            least.append(out)
        # The least distance of a name with a part, and one from which it is among few to be tried:
        # one of the two parts of a name has at most half of what its distance exceeds the least.
        lowest, tried = [], []
        for side, (part, codes) in enumerate(zip(self.parts, asked.codes)):
            own, other = least[side], least[1 - side][::-1]
            bound, turn = np.empty((len(part.count), n), kind), np.empty((len(part.count), n), kind)
            once, twice = (other + steps)[:, None], (other - own + 2 * steps + kind(side))[:, None]
            for depth, text, column in part.tree.columns(codes, kind):
                bound[text] = (column + once).min(axis=0) + kind(depth)
                column = column + column
                column += twice
                turn[text] = column.min(axis=0) + kind(2 * depth)
            lowest.append(np.ascontiguousarray(bound.T))
            tried.append(np.ascontiguousarray(turn.T))
        k = np.maximum(lowest[0].min(axis=1).astype(np.int64), k)
        rest, done = np.flatnonzero(k <= limits), [self._first([])]
        while len(rest):
            hits: list = []
            for side in (0, 1):
                q, part = np.divmod(np.flatnonzero(tried[side][rest] <= k[rest][:, None]), tried[side].shape[1])
                self._join(side, rest[q], part, lambda own: lowest[1 - side][own] <= k[own][:, None], k, asked, hits)
            done.append(self._first(hits))
            rest = np.setdiff1d(rest, done[-1][0])
            k[rest] += 1
            rest = rest[k[rest] <= limits[rest]]
        return tuple(np.concatenate(x) for x in zip(*done))

    def _join(
        self, side: int, q: np.ndarray, part: np.ndarray, inside: Callable[[np.ndarray], np.ndarray],
        most: np.ndarray, asked: Asked, hits: list,
    ) -> None:
        """Names of parts (by asked name) whose other part is inside, too, if near enough."""
        mine, others = self.parts[side], len(self.parts[1 - side].count)
        begins = np.flatnonzero(np.diff(q, prepend=-1))
        ends = np.append(begins[1:], len(q))[: len(begins)]
        count = mine.count[part]
        total, at = np.concatenate([[0], np.cumsum(count)]), 0
        while at < len(begins):
            last = int(np.searchsorted(total[ends], total[begins[at]] + COMPARED, side="right"))
            last = min(max(at + 1, last), at + max(1, TABLE // others))
            some = slice(begins[at], ends[last - 1])
            row = np.repeat(np.arange(last - at) * others, ends[at: last] - begins[at: last])
            each = np.repeat(np.arange(some.start, some.stop), count[some])
            name = np.arange(len(each)) + np.repeat(mine.begin[part[some]] - total[some] + total[some.start], count[some])
            good = inside(q[begins[at: last]]).ravel().take(mine.joined.take(name) + row.take(each - some.start))
            good = np.flatnonzero(good)
            self.measured += len(each)
            own, name = q[each[good]], mine.names[name[good]]
            d = asked.distances(own, name)
            near = d <= most[own]
            hits.append((own[near], name[near], d[near]))
            at = last

    def _first(self, hits: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest name of each asked one, the first in order of those equally near."""
        q, name, d = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 3
        if not len(q):
            return q, name, d
        least = np.full(int(q.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, q, d)
        good = d == least[q]
        q, d, (held, name) = q[good], d[good], np.unique(name[good], return_inverse=True)
        rank = np.empty(len(held), np.int64)
        rank[pc.array_sort_indices(self.names.take(pa.array(held))).to_numpy()] = np.arange(len(held))
        order = np.lexsort((rank[name], q))
        order = order[np.diff(q[order], prepend=-1) > 0]
        return q[order], held[name[order]], d[order]


class Asked:
    """Some asked names of one length, and their distances to names."""

    def __init__(self, trie: NameTrie, texts: pa.Array, size: int) -> None:
        self.trie, self.names = trie, Names(texts)
        codes = self.names.codes.reshape(len(texts), size).T
        #: A column of letters for each name, read forwards and backwards.
        self.codes = np.ascontiguousarray(codes), np.ascontiguousarray(codes[::-1])
        self.words = Words(self.names, trie.alphabet, np.zeros(0, np.int32), self.names) if 0 < size <= WORD else None

    def distances(self, q: np.ndarray, name: np.ndarray) -> np.ndarray:
        some, name = np.unique(name, return_inverse=True)
        held = Names(self.trie.names.take(pa.array(some)))
        if self.words is None:
            return edit_distances(self.names, held, q, name)
        self.words.held, self.words.ids = held, self.trie.lookup[held.codes]
        return self.words.distances(q, name)


def _cut(names: pa.Array, place: int) -> tuple[pa.Array, pa.Array]:
    """Beginnings and endings of names cut after so many letters, or before the last ones."""
    return pc.utf8_slice_codeunits(names, 0, place), pc.utf8_slice_codeunits(names, place)


def _least(found: tuple[np.ndarray, np.ndarray, np.ndarray], most: np.ndarray) -> np.ndarray:
    """The least distance of a part to the first letters of each asked name, at most ``most``."""
    q, _, distances = found
    out = most.copy()
    if len(q):
        begins = np.flatnonzero(np.diff(q, prepend=-1))
        out[:, q[begins]] = np.minimum(out[:, q[begins]], np.minimum.reduceat(distances, begins, axis=1))
    return out

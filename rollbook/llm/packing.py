"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Pieces are dealt at random into blocks of bounded size. For every block, several islands
each evolve a small population: a crossover puts whole well-filled sequences of one parent
into a copy of the other, drops the sequences that now hold a piece twice, and best-fits
the pieces so displaced. Islands are rows of a DataFrame; between rounds each passes its
best solution to the next island of its block through a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollbook import session
from rollbook.llm import tokens

#: Pieces in a block, on average.
BLOCK_PIECES = 4000
ISLANDS = 2
ROUNDS = 2
POPULATION = 4
GENERATIONS = 6
#: Displaced pieces of a child, longest first, that try to replace a smaller one.
REPLACED = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_STATE = "block long, island int, lengths binary, ats binary, bins array<binary>"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, words: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document of ``docs`` (doc_id, text).

    A null or empty text is the end id alone; only longer documents are cut, and all
    pieces but the last are full. Repeated rows are separate documents.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.give_back()
        encode = tokens.encoder(tokenizer, words).encode
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at: at + step]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out) if out else [[]] * 5, kinds)], names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(cut, PIECES)


class Bins:
    """Open sequences of one block, found by the room left in them."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.rooms, self.by_room, self.held = capacity, 0, {}, []

    def add(self, items: list[int], room: int) -> None:
        self._file(len(self.held), room)
        self.held.append(items)

    def _file(self, number: int, room: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(number)
            self.rooms |= 1 << room

    def best_fit(self, item: int, length: int) -> None:
        """Into the sequence that it fills most, or a new one."""
        wide = self.rooms >> length
        if not wide:
            self.add([item], self.capacity - length)
            return
        room = length + (wide & -wide).bit_length() - 1
        same = self.by_room[room]
        number = same.pop()
        if not same:
            self.rooms ^= 1 << room
        self.held[number].append(item)
        self._file(number, room - length)


def decreasing(lengths: list[int], order: list[int], capacity: int) -> list[list[int]]:
    bins = Bins(capacity)
    for i in order:
        bins.best_fit(i, lengths[i])
    return bins.held


def least_sequences(lengths: list[int], capacity: int) -> int:
    """No packing has fewer sequences.

    Items of more than half a sequence each need one; below a length k, items are left out,
    and what lies between must fit beside those large items that leave room for it.
    """
    x = np.sort(np.array(lengths, dtype=np.int64))
    sums = np.concatenate([[0], np.cumsum(x)])
    at_half = int(np.searchsorted(x, capacity / 2, side="right"))
    k = np.unique(np.append(x[:at_half], 0))
    low, high = np.searchsorted(x, k), np.maximum(np.searchsorted(x, capacity - k, side="right"), at_half)
    room = (high - at_half) * capacity - (sums[high] - sums[at_half])
    rest = -(-np.maximum(sums[at_half] - sums[low] - room, 0) // capacity)
    return int((len(x) - at_half + rest).max()) if len(x) else 0


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then fuller ones (mean square of fill)."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def cross(one: list[list[int]], other: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """A child of ``one`` that holds a run of well-filled sequences of ``other``.

    Sequences of ``one`` that hold a piece of the run are dropped, and a few others that
    are not full; their pieces first replace smaller ones where that fills a sequence
    better, and are then best-fitted, longest first.
    """
    good = sorted(other, key=lambda b: -sum(lengths[i] for i in b))
    share = max(1, len(good) // 8)
    begin = int(rng.integers(0, max(1, len(good) // 2 - share + 1)))
    held = [list(b) for b in good[begin: begin + share]]
    taken = {i for b in held for i in b}
    emptied = set(rng.choice(len(one), size=min(len(one), 2 + len(one) // 50), replace=False).tolist())
    displaced: list[int] = []
    for k, b in enumerate(one):
        if taken.isdisjoint(b) and not (k in emptied and sum(lengths[i] for i in b) < capacity):
            held.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    size, where = np.array(lengths, dtype=np.int64), np.full(len(lengths), -1)
    for k, b in enumerate(held):
        where[b] = k
    room = np.array([capacity - sum(lengths[i] for i in b) for b in held], dtype=np.int64)
    waiting = []
    for n, i in enumerate(sorted(displaced, key=lambda i: -lengths[i])):
        gain = size[i] - size
        gain[(where < 0) | (gain > room[where])] = 0
        j = int(gain.argmax()) if n < REPLACED else i
        if gain[j] > 0:
            room[where[j]] -= gain[j]
            where[i], where[j] = where[j], -1
        waiting.append(j if gain[j] > 0 else i)
    child = Bins(capacity)
    order = np.argsort(where, kind="stable")
    order = order[where[order] >= 0]
    for b in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(order) else []:
        child.add(b.tolist(), int(room[where[b[0]]]))
    for i in sorted(waiting, key=lambda i: -lengths[i]):
        child.best_fit(i, lengths[i])
    return child.held


def founders(lengths: list[int], population: list[list[list[int]]], capacity: int, rng: np.random.Generator) -> list[list[list[int]]]:
    """Fill a population with best fits in slightly disturbed orders of length."""
    out = list(population)
    while len(out) < POPULATION:
        noise = np.array(lengths) * rng.uniform(0.8, 1.2, len(lengths))
        out.append(decreasing(lengths, np.argsort(-noise, kind="stable").tolist(), capacity))
    return out


def evolve(lengths: list[int], population: list[list[list[int]]], capacity: int, rng: np.random.Generator, generations: int) -> list[list[list[int]]]:
    """Best solutions first; after one generation, stops where no solution can have fewer sequences."""
    least = least_sequences(lengths, capacity)
    scored = sorted(((fitness(p, lengths, capacity), p) for p in population), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        children = []
        for _ in range(POPULATION):
            a, b = rng.integers(0, len(scored), 2)
            child = cross(scored[min(a, b)][1], scored[max(a, b)][1] if a != b else scored[0][1], lengths, capacity, rng)
            children.append((fitness(child, lengths, capacity), child))
        scored = sorted(scored + children, key=lambda x: x[0], reverse=True)[:POPULATION]
        if len(scored[0][1]) <= least:
            break
    return [p for _, p in scored]


def _numbers(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, dtype=np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _lists(numbers: bytes) -> list[list[int]]:
    of = np.frombuffer(numbers, np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)] if len(of) else []


def pack(items: DataFrame, capacity: int, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """Place ``items`` (at, length): adds sequence_id and offset.

    ``at`` is unique; ``length`` lies between 1 and ``capacity``. Full items are
    sequences of their own. Every other block of items is packed for itself, which costs
    less than one sequence a block. Every block passes founders and a generation on each
    island; one at its lower bound then stops. An empty table gives no rows.
    """
    full = items.filter(F.col("length") == capacity).select("at", (-1 - F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.filter(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block_pieces))

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens.forget()
        pdf = pdf.sort_values(["length", "at"], ascending=[False, True])
        lengths = pdf["length"].to_numpy(np.int64)
        sizes = lengths.tolist()
        bins = decreasing(sizes, range(len(sizes)), capacity)
        row = {"block": int(pdf["block"].iloc[0]), "island": 0, "lengths": lengths.astype(np.int32).tobytes(), "ats": pdf["at"].to_numpy(np.int64).tobytes(), "bins": [_numbers(bins, len(sizes))]}
        return pd.DataFrame([row])

    def island(frames: Iterator[pd.DataFrame], turn: int) -> Iterator[pd.DataFrame]:
        tokens.forget()
        for pdf in frames:
            found = []
            for row in pdf.itertuples():
                lengths = np.frombuffer(row.lengths, np.int32).tolist()
                population = [_lists(b) for b in row.bins]
                if turn and min(map(len, population)) <= least_sequences(lengths, capacity):
                    found.append(list(row.bins))
                    continue
                rng = np.random.default_rng([row.block, row.island, turn])
                best = evolve(lengths, founders(lengths, population, capacity, rng), capacity, rng, GENERATIONS)
                found.append([_numbers(b, len(lengths)) for b in best[:2]])
            yield pdf.assign(bins=found)

    dealt = rest.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)))
    state = session.materialize(dealt.groupBy("block").applyInPandas(begin, _STATE), "pack-blocks")
    open_ = state.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    # Rows are few and small but take seconds each: a fixed number of partitions, which
    # adaptive execution does not draw together.
    tasks = min(blocks * islands, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for turn in range(rounds):
        evolved = open_.repartition(tasks, "block", "island").mapInPandas(lambda frames, turn=turn: island(frames, turn), _STATE)
        open_ = session.materialize(evolved, "pack-islands")
        if turn + 1 < rounds and islands > 1:
            # Elite migration: the best of island i joins the population of island i + 1.
            elite = open_.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("bins", 1, 1).alias("guest"))
            open_ = open_.join(elite, ["block", "island"]).withColumn("bins", F.concat("bins", "guest")).select(state.columns)

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for block, rows in pdf.groupby("block"):
                first = rows.iloc[0]
                lengths = np.frombuffer(first["lengths"], np.int32).tolist()
                best = max((_lists(b) for own in rows["bins"] for b in own), key=lambda b: fitness(b, lengths, capacity))
                ats = np.frombuffer(first["ats"], np.int64)
                out = [(ats[i], k, o) for k, b in enumerate(best) for i, o in zip(b, np.cumsum([0] + [lengths[i] for i in b]).tolist())]
                yield pd.DataFrame({"at": [x[0] for x in out], "sequence_id": [(int(block) << 32) + x[1] for x in out], "offset": [x[2] for x in out]})

    # The islands of a block, a fixed number of rows, meet to give the best solution.
    placed = open_.groupBy("block").applyInPandas(lambda pdf: pd.concat(places([pdf])), "at long, sequence_id long, offset long")
    return full.unionByName(placed)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of ``docs`` with the sequence and offset where each lies.

    Workers get texts in small batches and drop their encoder when pieces are packed.
    """
    cut = pieces(docs, tokenizer, end_id, capacity).withColumn("at", F.monotonically_increasing_id())
    with session.small_batches(docs.sparkSession):
        cut = session.materialize(cut, "pack-pieces")
    return cut.join(pack(cut.select("at", "length"), capacity), "at").drop("at")

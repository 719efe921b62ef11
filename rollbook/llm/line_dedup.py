"""Removal of lines that many documents hold, behind two Bloom filters.

A first pass over the texts sets, for the hash of every long line, two bits of a filter of
lines seen once; bits that another document had set before are set in a second filter of
lines seen twice. Only lines that the second filter suspects are shuffled, as digests, to
be counted exactly and to choose the one document that keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from rollbook.llm import repeats, words as w
from rollbook.llm.prefix import unfold

#: The filter has at least two bits for a line of the least length if all text were such
#: lines, and at most ``1 << MOST_BITS`` bits (32 MB). A fuller filter suspects more lines;
#: it never loses one.
MOST_BITS = 28
#: Bits of a slice of the filter, and hashes that a task holds before it hands on their bits.
SLICE_BITS = 16
HELD_HASHES = 1 << 22

_SET = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_SUSPECT = pa.schema([("digest", pa.binary()), ("hash", pa.int64()), ("block", pa.int32()), ("docs", pa.int64()), ("last", pa.int64())])


@dataclass
class Lines:
    """Lines of some texts, ``starts:ends`` with their white space and ``left:right`` without."""

    data: np.ndarray
    lowered: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    left: np.ndarray
    right: np.ndarray
    long: np.ndarray

    def texts_of_lines(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lines: np.ndarray) -> np.ndarray:
        return w.span_hashes(self.lowered, self.left[lines], self.right[lines])

    def digest(self, line: int) -> bytes:
        return hashlib.sha256(self.lowered[self.left[line]: self.right[line]]).digest()[:16]


def lines_of(data: np.ndarray, offsets: np.ndarray, least_chars: int) -> Lines:
    """Split texts at line feeds; ``long`` numbers the lines whose key has ``least_chars``."""
    breaks = np.flatnonzero(data == 10)
    # Ends of texts and lines rise together, so sorting pairs starts with ends.
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    first = np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(breaks, offsets)) + 1)])
    solid = np.flatnonzero(~w.SEPARATOR[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = np.flatnonzero(b > a)
    left, right = starts.copy(), starts.copy()
    left[some], right[some] = solid[a[some]], solid[b[some] - 1] + 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    lowered = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    return Lines(data, lowered, first, starts, ends, left, right, np.flatnonzero(chars[right] - chars[left] >= least_chars))


def each_chunk(data: np.ndarray, offsets: np.ndarray, least_chars: int) -> Iterator[Lines]:
    for i, j in w.chunks(offsets):
        at = offsets[i: j + 1]
        yield lines_of(data[at[0]: at[-1]], at - at[0], least_chars)


def bits_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The two places of every hash in a filter of ``1 << width`` bits, one after the other."""
    shift = np.uint64(64 - width)
    return np.concatenate([hashes >> shift, w.mix(hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) >> shift]).astype(np.int64)


def suspected(twice: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    at = bits_of(hashes, width)
    held = (twice[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return (held[: len(hashes)] & held[len(hashes):]).astype(bool)


def _sliced(once: np.ndarray, twice: np.ndarray, width: int) -> pa.RecordBatch:
    """Sorted places of bits, cut into slices."""
    edges = np.arange(0, (1 << width) + 1, 1 << SLICE_BITS)
    at = [np.searchsorted(x, edges) for x in (once, twice)]
    low = [(x & ((1 << SLICE_BITS) - 1)).astype(np.uint16) for x in (once, twice)]
    rows = [(int(k), *(x[c[k]: c[k + 1]].tobytes() for x, c in zip(low, at))) for k in np.flatnonzero(np.diff(at[0]))]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, _SET.types)], schema=_SET)


def twice_seen(docs: DataFrame, text: str, width: int, least_chars: int) -> np.ndarray:
    """The filter of long lines that two documents hold, as packed bits.

    What tasks hand on is places of set bits, so it grows with the lines; merging streams
    over them and holds the filter at most once in a task.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def bits() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return _sliced(np.unique(bits_of(hashes, width)), np.unique(bits_of(hashes[n > 1], width)), width)

        for batch in batches:
            for lines in each_chunk(*w.text_buffers(batch.column(0)), least_chars):
                own, hashes = lines.texts_of_lines()[lines.long], lines.hashes(lines.long)
                order = np.lexsort((hashes, own))
                own, hashes = own[order], hashes[order]
                # A line repeated in one document counts once.
                new = np.ones(len(own), dtype=bool)
                new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
                held.append(hashes[new])
                if sum(map(len, held)) >= HELD_HASHES:
                    yield bits()
        if held:
            yield bits()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                seen, again = filters.setdefault(k, (np.zeros(1 << SLICE_BITS, dtype=bool), np.zeros(1 << SLICE_BITS, dtype=bool)))
                at = np.frombuffer(once, np.uint16)
                again[at[seen[at]]] = True
                again[np.frombuffer(twice, np.uint16)] = True
                seen[at] = True
        for k, (_, again) in filters.items():
            if again.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "bits": [np.packbits(again, bitorder="little").tobytes()]})

    sets = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(places, "slice int, once binary, twice binary")
    merged = sets.repartition("slice").mapInArrow(merge, "slice int, bits binary")
    out = np.zeros(1 << (width - 3), dtype=np.uint8)
    step = 1 << (SLICE_BITS - 3)
    for r in merged.collect():  # at most the filter
        out[r.slice * step: (r.slice + 1) * step] = np.frombuffer(r.bits, np.uint8)
    return out


def drop_repeated_lines(
    docs: DataFrame, text: str = "text", order: str = "doc_id", least_chars: int = 40, least_docs: int = 5, most_bits: int = MOST_BITS,
    block_bytes: int = repeats.BLOCK_BYTES,
) -> DataFrame:
    """Drop long lines that ``least_docs`` documents hold, but for the document last in order.

    A line's key is the line without white space at both ends, A-Z as a-z. All lines of a key
    of at least ``least_chars`` code points that occurs in ``least_docs`` documents go, except
    in the documents of the largest ``order`` (a whole number) among those that hold it.

    Adds n_lines (before), n_dropped, kept_sha256 and kept, the other lines joined by line
    feeds. A null or empty text is one empty line; a null stays null in ``kept``. Rows are
    documents, also repeated ones: each counts, and equal largest ids all keep the line. A
    null id is below all others. Other columns stay, a column named as a result is replaced.
    An empty table gives no rows. ``docs`` must give its rows in the same places when it is
    read again, as stored tables do.
    """
    if least_docs < 2:
        raise ValueError("lines are compared between two documents at least")
    held = repeats.held_bytes(docs, text)
    rows = repeats.in_blocks(docs, held, block_bytes)
    width = min(max(int(2 * held // least_chars).bit_length(), SLICE_BITS), max(most_bits, SLICE_BITS))
    filter_ = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, text, width, least_chars))

    def publish(table: pa.Table) -> pa.Table:
        ids = pa.compute.struct_field(table.column("row"), order).to_pylist()
        found: dict[bytes, list] = {}
        begin = 0
        for lines in each_chunk(*repeats.texts_of(table, text), least_chars):
            hashes = lines.hashes(lines.long)
            owner = lines.texts_of_lines()
            for k in np.flatnonzero(suspected(filter_.value, hashes, width)):
                line = int(lines.long[k])
                place = begin + int(owner[line])
                entry = found.setdefault(lines.digest(line), [int(hashes[k].astype(np.int64)), -1, 0, None])
                if entry[1] != place:  # lines come in the order of documents
                    entry[1], entry[2] = place, entry[2] + 1
                    if ids[place] is not None and (entry[3] is None or ids[place] > entry[3]):
                        entry[3] = ids[place]
            begin += len(lines.first) - 1
        block = table.column("block")[0].as_py()
        out = [(d, h, block, n, last) for d, (h, _, n, last) in found.items()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, _SUSPECT.types)], schema=_SUSPECT)

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        keeper = dict(zip(replies.column("digest").to_pylist(), replies.column("keeper").to_pylist()))
        known = np.unique(replies.column("hash").to_numpy().astype(np.int64).view(np.uint64))
        ids = pa.compute.struct_field(table.column("row"), order).to_pylist()
        n_lines, n_dropped, digests, kept = [], [], [], []
        data, offsets = repeats.texts_of(table, text)
        nulls = np.asarray(pa.compute.is_null(pa.compute.struct_field(table.column("row"), text)))
        for lines in each_chunk(data, offsets, least_chars):
            stay, owner = np.ones(len(lines.starts), dtype=bool), lines.texts_of_lines()
            begin = len(kept)
            for line in lines.long[np.isin(lines.hashes(lines.long), known)].tolist():
                last = keeper.get(lines.digest(line), keeper)  # the dict itself stands for no entry
                stay[line] = last is keeper or last == ids[begin + int(owner[line])]
            raw = lines.data.tobytes()
            for k in range(len(lines.first) - 1):
                a, b = int(lines.first[k]), int(lines.first[k + 1])
                gone = int(b - a - stay[a:b].sum())
                whole = raw[lines.starts[a]: lines.ends[b - 1]]
                if gone:
                    whole = b"\n".join([raw[lines.starts[x]: lines.ends[x]] for x in range(a, b) if stay[x]])
                n_lines.append(b - a)
                n_dropped.append(gone)
                digests.append(hashlib.sha256(whole).hexdigest())
                kept.append(None if nulls[len(kept)] else whole.decode())
        slim = w.fields_of(table.column("row"), others) if others else None
        columns = {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_sha256": digests, "kept": pa.array(kept, pa.string())}
        return pa.table(({"row": slim} if others else {}) | columns)

    others = [c for c in docs.columns if c != text]
    schema = f"row {StructType([docs.schema[c] for c in others]).simpleString()}, n_lines long, n_dropped long, kept_sha256 string, kept string"
    suspects = rows.groupBy("block").applyInArrow(publish, "digest binary, hash long, block int, docs long, last long")
    # A line in a third of all documents is one row for each block here.
    same = Window.partitionBy("digest")
    counted = suspects.withColumns({"n": F.sum("docs").over(same), "keeper": F.max("last").over(same)})
    replies = counted.filter(F.col("n") >= least_docs).select("block", "digest", "hash", "keeper")
    return unfold(repeats.by_block(rows, replies, remove, schema), "n_lines", "n_dropped", "kept_sha256", "kept")

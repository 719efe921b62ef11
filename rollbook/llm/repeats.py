"""Hashes that occur more than once in a table of texts.

Texts are dealt into blocks of bounded bytes by one shuffle that all passes share. A block
publishes its distinct hashes, each once with its count in the block, to buckets by value;
a bucket adds up and answers every block with those of its hashes that occur at least twice.
A hash in a third of all rows is one entry for each block, never one for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rollbook.llm import words as w
from rollbook.llm.prefix import beside

#: Bytes of text in a block, and bytes of text whose hashes share a bucket, on average.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20

_ENTRY = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_REPLY = pa.schema([("block", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])


def held_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0


def in_blocks(docs: DataFrame, held: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` of ``held`` bytes as (row, block), dealt by the place of a row.

    Equal rows lie in different places, so they spread like any others. A lost task deals
    its rows as before as long as ``docs`` gives them in the same order, as stored tables do.
    """
    blocks = max(1, -(-held // block_bytes))
    return beside(docs).withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))


def dealt(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """``docs`` as (row, block), and the number of buckets for their hashes."""
    held = held_bytes(docs, text)
    return in_blocks(docs, held, block_bytes), max(1, -(-held // bucket_bytes))


def texts_of(table: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of a block."""
    column = pc.struct_field(table.column("row"), text)
    return w.text_buffers(column if pa.types.is_string(column.type) else column.cast(pa.string()))


def each_chunk(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Iterator[w.Words]:
    for i, j in w.chunks(offsets):
        at = offsets[i: j + 1]
        yield w.words_of(data[at[0]: at[-1]], at - at[0], lower)


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """``values[edges[k]: edges[k + 1]]`` as bytes, for each k."""
    width = values.dtype.itemsize
    buffers = [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, buffers)


def entries(block: int, parts: list[np.ndarray], buckets: int) -> pa.Table:
    """What a block publishes of its hashes: a row for each bucket that one falls into.

    Work and rows are bounded by the block's hashes, however many buckets there are.
    """
    hashes, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
    bucket = (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
    begins = np.concatenate([[True], bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, bool)
    edges = np.append(np.flatnonzero(begins), len(bucket))
    row = np.cumsum(begins) - 1
    # In a row those that repeat in the block come first, and only they have a count.
    many = counts > 1
    before = np.concatenate([[0], np.cumsum(many)])
    counted = before[edges]
    ahead = before[:-1] - counted[row]
    place = np.where(many, ahead, np.diff(counted)[row] + np.arange(len(row)) - edges[row] - ahead)
    shown = np.empty_like(hashes)
    shown[edges[row] + place] = hashes
    own = pa.array(np.full(len(edges) - 1, block, np.int32))
    return pa.Table.from_arrays([pa.array(bucket[edges[:-1]]), own, _packed(shown, edges), _packed(counts[many].astype(np.uint32), counted)], schema=_ENTRY)


def _answer(table: pa.Table) -> pa.Table:
    blocks = table.column("block").to_numpy()
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    counts = [np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]
    weights = np.concatenate([np.concatenate([c, np.ones(len(h) - len(c), np.uint32)]) for h, c in zip(hashes, counts)])
    row = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])
    every = np.concatenate(hashes)
    order = np.argsort(every)
    every, weights, row = every[order], weights[order], row[order]
    begins = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, int)
    totals = np.add.reduceat(weights.astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64)
    total = np.repeat(totals, np.diff(np.append(begins, len(every))))
    keep = total >= 2
    every, total, row = every[keep], np.minimum(total[keep], 0xFFFFFFFF).astype(np.uint32), row[keep]
    order = np.argsort(row, kind="stable")
    edges = np.searchsorted(row[order], np.arange(len(hashes) + 1))
    rows = [
        (int(blocks[r]), every[k].tobytes(), total[k].tobytes())
        for r in range(len(hashes)) if len(k := order[edges[r]: edges[r + 1]])
    ]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, _REPLY.types)], schema=_REPLY)


def repeated(published: DataFrame) -> DataFrame:
    """Replies (block, hashes, counts) to the entries of all blocks."""
    return published.groupBy("bucket").applyInArrow(_answer, "block int, hashes binary, counts binary")


ENTRY_SCHEMA = "bucket int, block int, hashes binary, counts binary"


class Known:
    """The repeated hashes of a block, for look-ups of many hashes at once."""

    def __init__(self, replies: pa.Table) -> None:
        hashes = [np.frombuffer(x, np.uint64) for x in replies.column("hashes").to_pylist()]
        counts = [np.frombuffer(x, np.uint32) for x in replies.column("counts").to_pylist()]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every)
        self.hashes = every[order]
        self.counts = (np.concatenate(counts) if counts else np.zeros(0, np.uint32))[order]
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def counts_of(self, hashes: np.ndarray) -> np.ndarray:
        """How often each hash occurs in the whole table; 0 stands for once."""
        out = np.zeros(len(hashes), dtype=np.uint32)
        if len(self.hashes):
            maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == hashes[maybe]
            out[maybe[same]] = self.counts[at[same]]
        return out


def by_block(rows: DataFrame, replies: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``fn`` to each block's rows and the replies it got."""
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(fn, schema)

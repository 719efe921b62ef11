"""Token ids in files of fixed-width bit fields.

A file holds blocks, one Parquet row each: the documents of the block, how many ids each
has, how many ids of the file lie before it, and the ids, every one in the fewest bits
that hold the vocabulary. Fields of equal width are unpacked with whole-array shifts, and
id number i of a block is found at bit ``i * bits`` without reading what is before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rollbook.llm import tokens

#: Ids after which a block ends; a longer document fills a block alone.
BLOCK_IDS = 1 << 17

FILE_SCHEMA = "file int, block int, before long, ids long, doc_ids array<bigint>, lengths array<bigint>, bits int, payload binary"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, lowest bit first, 32 ids in ``bits`` 32-bit words.

    An id that needs more bits is an error.
    """
    if len(ids) and int(np.max(ids)) >> bits:
        raise ValueError(f"id {int(np.max(ids))} does not fit {bits} bits")
    groups = -(-len(ids) // 32)
    padded = np.zeros(groups * 32, dtype=np.uint32)
    padded[: len(ids)] = ids
    padded = padded.reshape(groups, 32)
    words = np.zeros((groups, bits), dtype=np.uint32)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        words[:, word] |= padded[:, j] << np.uint32(shift)
        if shift + bits > 32:
            words[:, word + 1] |= padded[:, j] >> np.uint32(32 - shift)
    return words.astype("<u4").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from number ``start`` on; only the words that hold them are touched."""
    if count <= 0:
        return np.zeros(0, dtype=np.uint32)
    first, last = start // 32, (start + count - 1) // 32 + 1
    words = np.frombuffer(payload, "<u4", (last - first) * bits, first * bits * 4).reshape(-1, bits)
    out = np.empty((last - first, 32), dtype=np.uint32)
    mask = np.uint32((1 << bits) - 1)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        value = words[:, word] >> np.uint32(shift)
        if shift + bits > 32:
            value = value | (words[:, word + 1] << np.uint32(32 - shift))
        out[:, j] = value & mask
    return out.reshape(-1)[start - first * 32: start - first * 32 + count]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, words: bool = False, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``path`` in ascending ``doc_id``.

    Each document is followed by ``end_id``; a null or empty text is ``end_id`` alone.
    A null ``doc_id`` comes first; documents of equal ``doc_id`` are ordered by text hash.
    Other columns are ignored. An empty table gives files without blocks.
    """
    bits = bits_for(vocabulary)
    if end_id >> bits:
        raise ValueError("the end id lies outside the vocabulary")
    end = np.array([end_id], dtype="<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer, words).encode
        file = TaskContext.get().partitionId()
        number = before = held = 0
        doc_ids: list = []
        parts: list[bytes] = []

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [file, number, before, len(ids), doc_ids, [len(p) // 4 for p in parts], bits, pack(ids, bits)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()]
            names = ["file", "block", "before", "ids", "doc_ids", "lengths", "bits", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                if held and held + len(ids) // 4 > block_ids:
                    yield block()
                    number, before, held = number + 1, before + held, 0
                    doc_ids, parts = [], []
                doc_ids.append(doc_id)
                parts.append(ids)
                held += len(ids) // 4
        if held:
            yield block()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(blocks, FILE_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of the files below ``path`` with ``base``, the number of ids in earlier files."""
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = blocks.groupBy("file").agg(F.sum("ids").alias("ids"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    # One row for each file.
    return blocks.join(F.broadcast(totals), "file")


def documents(blocks: DataFrame) -> DataFrame:
    """One row for each document: doc_id, start, n_tokens, ids_crc32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for k in range(batch.num_rows):
                at, n, doc_ids, lengths, bits, payload = (c[k].as_py() for c in cols)
                ids = unpack(payload, bits, 0, n).astype("<u4").tobytes()
                ends = np.cumsum(np.array(lengths, dtype=np.int64))
                starts = ends - lengths
                crc = [zlib.crc32(ids[4 * a: 4 * b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + at), pa.array(np.array(lengths, dtype=np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    slim = blocks.select((F.col("base") + F.col("before")).alias("at"), "ids", "doc_ids", "lengths", "bits", "payload")
    return slim.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Removal of word windows that occur more than once in a corpus.

Anchors are hashes of short windows at the positions of a difference cover: a set of
residues that holds, for any two positions, a common shift to residues of the set. So two
equal windows of 35 words share an equal anchor at the same place inside, although only
5 of 21 positions have one. Windows around repeated anchors are then hashed in full, and
those that repeat are removed word by word.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from rollbook.llm import repeats, words as w
from rollbook.llm.prefix import unfold

#: Residues of which every difference modulo the period is the difference of two.
PERIOD = 21
COVER = (3, 6, 7, 12, 14)


def _covered(n: int) -> np.ndarray:
    at = np.zeros(PERIOD, dtype=bool)
    at[list(COVER)] = True
    return np.resize(at, n) if n else np.zeros(0, dtype=bool)


def _anchors(words: w.Words, length: int) -> np.ndarray:
    """First words of the anchors of all texts."""
    starts = words.windows(length)
    within = starts - np.repeat(words.first[:-1], words.counts)[starts]
    return starts[_covered(PERIOD)[within % PERIOD]]


def _repeated_words(words: w.Words, hashes: np.ndarray, window: int, known: repeats.Known) -> np.ndarray:
    starts = words.windows(window)
    starts = starts[known.counts_of(w.window_hashes(hashes, starts, starts + window)) >= 2]
    edge = np.zeros(len(words.starts) + 1, dtype=np.int32)
    edge[starts] += 1
    edge[starts + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """Remove every word covered by a window of ``window`` words whose word sequence also
    starts anywhere else, in the same text or another.

    Adds n_words, n_removed, kept_sha256 (of the kept words joined by single spaces) and
    kept: the text itself where nothing is removed, else its runs of kept words, white
    space inside a run as it was, joined by single spaces.

    Windows are judged on the input. Null counts as empty and stays null in ``kept``;
    repeated rows are separate texts, so all their windows repeat; texts shorter than a
    window stay. Sequences are compared by 64-bit hashes. An empty table gives no rows.
    """
    if window < PERIOD + 4:
        raise ValueError(f"a window has at least {PERIOD + 4} words")
    length = window - PERIOD + 1
    rows, buckets = repeats.dealt(docs, text)

    def publish_anchors(table: pa.Table) -> pa.Table:
        parts = []
        for words in repeats.each_chunk(*repeats.texts_of(table, text)):
            at = _anchors(words, length)
            parts.append(w.window_hashes(words.hashes(), at, at + length))
        return repeats.entries(table.column("block")[0].as_py(), parts, buckets)

    def publish_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        known, parts = repeats.Known(replies), []
        for words in repeats.each_chunk(*repeats.texts_of(table, text)):
            hashes, at = words.hashes(), _anchors(words, length)
            marks = np.zeros(len(hashes) + 1, dtype=np.int64)
            marks[1:][at[known.counts_of(w.window_hashes(hashes, at, at + length)) >= 2]] = 1
            near = np.cumsum(marks)
            starts = words.windows(window)
            starts = starts[near[starts + PERIOD] > near[starts]]
            parts.append(w.window_hashes(hashes, starts, starts + window))
        return repeats.entries(table.column("block")[0].as_py(), parts, buckets)

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        known = repeats.Known(replies)
        n_words, n_removed, digests, kept = [], [], [], []
        data, offsets = repeats.texts_of(table, text)
        nulls = np.asarray(pa.compute.is_null(pa.compute.struct_field(table.column("row"), text)))
        for words in repeats.each_chunk(data, offsets):
            gone = _repeated_words(words, words.hashes(), window, known)
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed = sums[words.first[1:]] - sums[words.first[:-1]]
            n_words += words.counts.tolist()
            n_removed += removed.tolist()
            for k in range(len(removed)):
                raw = words.data[words.offsets[k]: words.offsets[k + 1]].tobytes()
                parts = raw.split()
                if removed[k]:
                    stay = ~gone[words.first[k]: words.first[k + 1]]
                    digests.append(hashlib.sha256(b" ".join(compress(parts, stay))).hexdigest())
                    flips = np.flatnonzero(np.diff(np.concatenate([[0], stay.view(np.int8), [0]])))
                    begin = words.starts[words.first[k]: words.first[k + 1]] - words.offsets[k]
                    end = words.ends[words.first[k]: words.first[k + 1]] - words.offsets[k]
                    kept.append(b" ".join([raw[begin[a]: end[b - 1]] for a, b in flips.reshape(-1, 2)]).decode())
                else:
                    digests.append(hashlib.sha256(b" ".join(parts)).hexdigest())
                    kept.append(None if nulls[len(kept)] else raw.decode())
        slim = w.fields_of(table.column("row"), others) if others else None
        columns = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": digests, "kept": pa.array(kept, pa.string())}
        return pa.table(({"row": slim} if others else {}) | columns)

    others = [c for c in docs.columns if c != text]
    kinds = StructType([docs.schema[c] for c in others])
    schema = (f"row {kinds.simpleString()}, " if others else "") + "n_words long, n_removed long, kept_sha256 string, kept string"
    anchors = repeats.repeated(rows.groupBy("block").applyInArrow(publish_anchors, repeats.ENTRY_SCHEMA))
    windows = repeats.repeated(repeats.by_block(rows, anchors, publish_windows, repeats.ENTRY_SCHEMA))
    out = repeats.by_block(rows, windows, remove, schema)
    return unfold(out, "n_words", "n_removed", "kept_sha256", "kept") if others else out

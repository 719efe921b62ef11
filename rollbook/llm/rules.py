"""Quality rules, and an isolation forest on their statistics.

Each text gives counts (words, characters, symbols, repeated lines and windows), a pass over
bytes and word hashes. Their ratios are the coordinates in which the forest isolates
documents by random splits; a short mean path marks an anomaly. How short is too short
comes from labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollbook import session
from rollbook.llm import words as w

#: Trees, and documents that each is grown on: together the bound of the fitted sample.
TREES = 256
TREE_ROWS = 32
#: Share of labelled good documents that the threshold may reject.
GOOD_REJECTED = 0.002

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_punctuation",)
#: Repeated lines are left out: good documents have them too, and the forest would isolate
#: those first.
RATIOS = ("chars", "symbols", "repeats", "punctuation")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


# Fixed values.
_SYMBOL = _table("#*$%&|<>")
_PUNCTUATION = _table("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(texts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes in order of place: has it an equal one in its text, has it an earlier one."""
    keys = hashes ^ w.mix(texts.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = (keys[order][1:] == keys[order][:-1]) & (texts[order][1:] == texts[order][:-1]) if len(keys) > 1 else False
    later, any_ = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order] = same[:-1]
    any_[order] = same[:-1] | same[1:]
    return any_, later


def counts(words: w.Words) -> dict[str, np.ndarray]:
    """The statistics of every text."""
    data, offsets, n = words.data, words.offsets, len(words.first) - 1
    inside = ~w.SEPARATOR[data]
    out = {
        "n_words": words.counts, "word_chars": _per_text(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_punctuation": _per_text(_PUNCTUATION[data], offsets),
    }
    feeds = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    begins = begins[begins < len(data)]
    text = np.searchsorted(offsets, begins, side="right") - 1
    ends = np.append(begins[1:], len(data))
    ends = np.where((ends > begins) & (data[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(begins) else ends[:0]
    filled = np.concatenate([[0], np.cumsum(inside)])
    worded = filled[ends] > filled[begins]
    begins, ends, text = begins[worded], ends[worded], text[worded]
    _, later = _repeated(text, w.span_hashes(data, begins, ends))
    out["n_dup_lines"] = np.bincount(text[later], minlength=n)
    starts = words.windows(WINDOW)
    again, _ = _repeated(words.texts_of_words()[starts], w.window_hashes(words.hashes(), starts, starts + WINDOW))
    edge = np.zeros(len(words.starts) + 1, dtype=np.int64)
    np.add.at(edge, starts[again], 1)
    np.add.at(edge, starts[again] + WINDOW, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(edge[:-1]) > 0, words.first)
    return out


def ratios(counted: dict[str, np.ndarray]) -> np.ndarray:
    """Coordinates of the forest, one row for each text; texts without words are zeros."""
    c = {k: np.asarray(v, dtype=float) for k, v in counted.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack([c["word_chars"] / words, c["n_symbols"] / words, c["n_repeat_words"] / words, c["n_punctuation"] / chars], axis=1)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts, ``base_failed`` and the ratios (an array) of every text."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    names = COUNTS + EXTRA

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = w.text_buffers(batch.column(1))
            found: dict[str, list] = {k: [np.zeros(0, np.int64)] for k in names}
            for i, j in w.chunks(offsets):
                at = offsets[i: j + 1]
                for k, v in counts(w.words_of(data[at[0]: at[-1]], at - at[0])).items():
                    found[k].append(v)
            whole = {k: np.concatenate(v).astype(np.int64) for k, v in found.items()}
            failed = (whole["n_words"] < 20) | (100 * whole["n_repeat_words"] > 30 * whole["n_words"])
            x = ratios(whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(whole[k]) for k in COUNTS), pa.array(failed), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(RATIOS)).cast(pa.list_(pa.float64()))],
                ["doc_id", *COUNTS, "base_failed", "ratios"],
            )

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, ratios array<double>"
    return slim.mapInArrow(measure, schema)


def mean_path(n: int) -> float:
    """Mean path length of a search that fails in a random tree of ``n`` points."""
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow(points: np.ndarray, rng: np.random.Generator, deepest: int) -> np.ndarray:
    """An isolation tree as rows (feature or -1, split, left, right, path length)."""
    nodes: list[list[float]] = []

    def add(part: np.ndarray, depth: int) -> int:
        number = len(nodes)
        nodes.append([-1, 0, 0, 0, depth + mean_path(len(part))])
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if depth < deepest and len(part) > 1 and len(open_):
            f = int(rng.choice(open_))
            split = float(rng.uniform(low[f], high[f]))
            left = part[:, f] <= split
            nodes[number][:4] = [f, split, add(part[left], depth + 1), add(part[~left], depth + 1)]
        return number

    add(points, 0)
    return np.array(nodes)


def fit(stats: DataFrame, trees: int = TREES, tree_rows: int = TREE_ROWS) -> list[np.ndarray]:
    """Trees grown on about ``tree_rows`` documents each, chosen by hash among those that
    pass the base rules; an empty table gives no trees."""
    usable = stats.filter("not base_failed")
    n = usable.count()
    if not n:
        return []
    key = F.xxhash64("doc_id", "ratios")
    per_tree = min(1.0, tree_rows / n)
    # A document serves a tree with this chance; small tables serve several trees.
    picked = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(key, t), F.lit(1 << 30)) < int(per_tree * (1 << 30)))
    sample = usable.withColumn("tree", F.explode(picked)).select("tree", "ratios")

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.array(pdf["ratios"].tolist())
        points = points[np.lexsort(points.T)]
        number = int(pdf["tree"].iloc[0])
        tree = grow(points, np.random.default_rng(number), math.ceil(math.log2(max(2, tree_rows))))
        return pd.DataFrame([{"tree": number, "nodes": tree.tobytes()}])

    grown = sample.groupBy("tree").applyInPandas(plant, "tree int, nodes binary").collect()
    return [np.frombuffer(r["nodes"]).reshape(-1, 5) for r in sorted(grown, key=lambda r: r["tree"])]


def paths(points: np.ndarray, forest: list[np.ndarray]) -> np.ndarray:
    """Mean path length of each point."""
    total = np.zeros(len(points))
    rows = np.arange(len(points))
    for tree in forest:
        feature, at = tree[:, 0].astype(np.int64), np.zeros(len(points), dtype=np.int64)
        inner = rows[feature[at] >= 0]
        while len(inner):
            here = at[inner]
            left = points[inner, feature[here]] <= tree[here, 1]
            at[inner] = np.where(left, tree[here, 2], tree[here, 3]).astype(np.int64)
            inner = inner[feature[at[inner]] >= 0]
        total += tree[at, 4]
    return total / max(1, len(forest))


def anomalies(stats: DataFrame, forest: list[np.ndarray], tree_rows: int = TREE_ROWS) -> DataFrame:
    """Add ``anomaly``, from 0 to 1: two to the power of minus the mean path over its norm."""
    held = stats.sparkSession.sparkContext.broadcast(forest)
    norm = mean_path(tree_rows)
    names = [c for c in stats.columns if c != "ratios"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ratios"))
            points = column.flatten().to_numpy().reshape(-1, len(RATIOS))
            scored = 2.0 ** (-paths(points, held.value) / norm)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(scored)], [*names, "anomaly"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields if f.name != "ratios")
    return stats.mapInArrow(apply, f"{fields}, anomaly double")


def judge(docs: DataFrame, labels: DataFrame, good_rejected: float = GOOD_REJECTED) -> DataFrame:
    """One row for each document: doc_id, the counts, base_failed, anomaly, kept.

    ``labels`` has (doc_id, label); the threshold is the anomaly that all but the share
    ``good_rejected`` of the rows labelled 1 stay below, of those that pass the base rules.
    A null text has no words and fails. Repeated rows get equal verdicts. Without labels
    the forest rejects nothing; an empty table gives no rows.
    """
    stats = session.materialize(statistics(docs), "rule-statistics")
    scored = session.materialize(anomalies(stats, fit(stats)), "rule-anomalies")
    good = labels.filter("label = 1").select("doc_id").distinct()
    limit = scored.filter("not base_failed").join(good, "doc_id").agg(F.percentile_approx("anomaly", 1 - good_rejected, 100_000)).first()[0]
    verdict = F.lit(True) if limit is None else F.col("anomaly") <= float(limit)
    return scored.withColumn("kept", ~F.col("base_failed") & verdict)

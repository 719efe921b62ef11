"""Text quality by logistic regression on hashed word n-grams.

Features are hashed counts of words, word pairs, word shapes and shape pairs, each kind as
shares of its total, so a score is a sparse dot product: the mean weight of all features of
a text. Weights are learnt by follow-the-regularised-leader updates, one labelled text at a
time, on a bounded number of shards whose states are averaged between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollbook import session
from rollbook.llm import words as w
from rollbook.llm.prefix import beside, unfold

#: Hashed features, and the number of kinds of features.
DIMENSIONS = 1 << 18
KINDS = 4
#: Labelled texts that a model is fitted on at most, the shards they are dealt to, and
#: rounds over them.
SAMPLE = 16_000
SHARDS = 4
ROUNDS = 4

# Classes of bytes in a shape. Runs of one class are one sign.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a"): ord("z") + 1] = ord("a")
_SHAPE[ord("A"): ord("Z") + 1] = ord("A")
_SHAPE[ord("0"): ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")


def shape_hashes(words: w.Words) -> np.ndarray:
    """Hash of each word's shape: letters, capitals, digits and signs, runs drawn together."""
    signs = _SHAPE[words.data]
    new = np.ones(len(signs), dtype=bool)
    new[1:] = signs[1:] != signs[:-1]
    new[words.starts] = True
    place = np.concatenate([[0], np.cumsum(new)])
    return w.span_hashes(signs[new], place[words.starts], place[words.ends])


def features(words: w.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: hashed features in order of texts, and the edges of texts."""
    out = []
    one, shape, first = words.hashes(), shape_hashes(words), words.first
    pairs = words.windows(2)
    pair_edges = np.searchsorted(pairs, first)
    same = (one[pairs] == one[pairs + 1]).astype(np.uint64)  # a word twice in a row is a shape pair of its own
    for kind, (h, edges) in enumerate((
        (one, first), (w.window_hashes(one, pairs, pairs + 2), pair_edges), (shape, first), (w.window_hashes(shape, pairs, pairs + 2) + same, pair_edges),
    )):
        salted = w.mix(h + np.uint64(kind))
        out.append(((salted & np.uint64(DIMENSIONS - 1)).astype(np.int64), edges))
    return out


def sparse(words: w.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and values of each text."""
    kinds = features(words)
    for k in range(len(words.first) - 1):
        index, value = [], []
        for h, edges in kinds:
            part = h[edges[k]: edges[k + 1]]
            if len(part):
                i, c = np.unique(part, return_counts=True)
                index.append(i)
                value.append(c / len(part))
        if not index:
            yield np.zeros(0, np.int64), np.zeros(0)
            continue
        index, value = np.concatenate(index), np.concatenate(value)
        i, back = np.unique(index, return_inverse=True)
        yield i, np.bincount(back, value)


@dataclass
class Model:
    """State of the updates; weights follow from it."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 1.0
    beta: float = 1e-2
    l1: float = 2e-3
    l2: float = 1e-3

    @classmethod
    def new(cls) -> Model:
        return cls(np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        at, x = np.append(index, DIMENSIONS), np.append(value, 0.1)  # the last is the bias
        weight = self.weights(at)
        g = (probability(float(weight @ x)) - label) * x
        square = g * g
        step = (np.sqrt(self.n[at] + square) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * weight
        self.n[at] += square


def probability(margin: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def margins(words: w.Words, weights: np.ndarray) -> np.ndarray:
    """Dot product of every text with the weights."""
    out = np.full(len(words.first) - 1, weights[DIMENSIONS] * 0.1)
    for h, edges in features(words):
        sums = np.concatenate([[0.0], np.cumsum(weights[h])])
        n = np.diff(edges)
        out += (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(n, 1)
    return out


def _learn_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Features of at most about ``sample`` labelled texts, stored.

    One row for each id, label and text hash: labels are chosen first, then, where ids repeat
    in ``docs``, rows by a hash of id and text, so that one id cannot hold a large share of them.
    """
    known = labels.filter("label is not null").select("doc_id", "label").distinct()
    count = known.count()
    share = min(1.0, sample / max(1, count))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The chosen labels have a bounded number of rows; so have the texts after the second choice.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(F.broadcast(chosen), "doc_id")
    texts = rows.select("doc_id", "label", "hash").distinct().count()
    share = min(1.0, sample / max(1, texts))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", "hash"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = rows.dropDuplicates(["doc_id", "label", "hash"]).select("doc_id", "text", "label")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = w.text_buffers(batch.column(1))
            index, value = [], []
            for i, j in w.chunks(offsets):
                at = offsets[i: j + 1]
                for a, b in sparse(w.words_of(data[at[0]: at[-1]], at - at[0])):
                    index.append(a.astype(np.int32).tobytes())
                    value.append(b.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["doc_id", "label", "index", "value"])

    return session.materialize(rows.mapInArrow(extract, "doc_id long, label int, index binary, value binary"), "classifier-sample")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shards: int = SHARDS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights learnt from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1).

    At most about ``sample`` labelled texts are used, chosen by a hash of ``doc_id``, and of
    ``doc_id`` and text where ids repeat; whole texts always. Rows of the same id, label and
    text count once. Null labels are left out. Without labels all weights are 0.
    """
    sc = docs.sparkSession.sparkContext
    rows = _learn_rows(docs, labels, sample).withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "index", "value"), F.lit(shards)))
    model = Model.new()

    def learner(held, turn: int):
        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            own = Model(held.value[0].copy(), held.value[1].copy())
            pdf = pdf.sort_values(["doc_id", "label", "index", "value"], kind="stable")
            for k in np.random.default_rng(turn).permutation(len(pdf)):
                row = pdf.iloc[k]
                own.learn(np.frombuffer(row["index"], np.int32), np.frombuffer(row["value"], np.float32).astype(float), int(row["label"]))
            return pd.DataFrame([{"texts": len(pdf), "z": own.z.astype(np.float32).tobytes(), "n": own.n.astype(np.float32).tobytes()}])

        return learn

    for turn in range(rounds):
        held = sc.broadcast((model.z, model.n))
        # A fixed number of states of fixed size.
        states = rows.groupBy("shard").applyInPandas(learner(held, turn), "texts long, z binary, n binary").collect()
        if not states:
            break
        total = sum(r["texts"] for r in states)
        states = sorted(states, key=lambda r: r["z"])
        model.z = sum(np.frombuffer(r["z"], np.float32).astype(float) * (r["texts"] / total) for r in states)
        model.n = sum(np.frombuffer(r["n"], np.float32).astype(float) * (r["texts"] / total) for r in states)
        held.unpersist()
    return model.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Add ``score``, the probability of label 1, from the whole text.

    A null text counts as empty; an empty text gets the score of the bias. Repeated rows get
    equal scores; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)
    rows, names = beside(docs), docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value.astype(float)
        for batch in batches:
            row = batch.column(0)
            column = row.field(row.type.get_field_index(text))
            data, offsets = w.text_buffers(column)
            found = [np.zeros(0)]
            for i, j in w.chunks(offsets):
                at = offsets[i: j + 1]
                found.append(margins(w.words_of(data[at[0]: at[-1]], at - at[0]), weights))
            row = w.fields_of(row, names)
            yield pa.RecordBatch.from_arrays([row, pa.array(probability(np.concatenate(found)))], ["row", "score"])

    return unfold(rows.mapInArrow(apply, f"row {docs.schema.simpleString()}, score double"), "score")

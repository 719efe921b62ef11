from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, row string, at long, score string"


def sentences(rng: random.Random, words: int) -> str:
    out = []
    for i in range(words):
        out.append("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 9))))
        if rng.random() < 0.1:
            out[-1] += rng.choice(".,;!?")
    return "".join(w + ("\n" if rng.random() < 0.05 else " ") for w in out).strip()


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, source): copies, near copies, shared passages, nulls, odd spaces."""
    rng = random.Random(5)
    texts = [sentences(rng, rng.choice([3, 12, 40, 80, 200, 400])) for _ in range(60)]
    passage = sentences(rng, 60)
    texts += [sentences(rng, 30) + " " + passage + "\n" + sentences(rng, 50) for _ in range(12)]
    for base in texts[:6]:
        words = base.split(" ")
        for _ in range(4):
            copy = list(words)
            for k in rng.sample(range(len(copy)), max(0, len(copy) // 60)):
                copy[k] = "changed"
            texts.append(" ".join(copy))
    texts += [texts[7]] * 9 + ["", None, "   \n\t ", "one", "Two words", "ÀÉ ß x　y  z", "\tlead\n\n\nend ", "a\x0bb\x0cc\rd", "x" * 5000, " ".join(["la"] * 300), "TODAY! today! 12's don't $$$ ### |a|"]
    texts.append(" ".join(sentences(rng, 3000).split(" ")))
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    return rows + [(None, "a row without an id " * 3, "s1"), rows[3], rows[3]]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with further columns whose names operators use themselves."""
    rows = [(i, t, "en", s, None if t is None else len(t), -1, "x", "y", -2, "z") for i, t, s in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("never_null", F.lit(1))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

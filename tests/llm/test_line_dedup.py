"""Line de-duplication against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from rollbook.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def expected(rows, least_chars, least_docs):
    held = defaultdict(list)
    for i, t in rows:
        for key in {key_of(x) for x in (t or "").split("\n")}:
            if len(key) >= least_chars:
                held[key].append(-(1 << 70) if i is None else i)
    keeper = {k: max(ids) for k, ids in held.items() if len(ids) >= least_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if keeper.get(key_of(x), i) == (-(1 << 70) if i is None else i) or key_of(x) not in keeper]
        whole = "\n".join(stay)
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256(whole.encode()).hexdigest(), None if t is None else whole))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(4)
    common = ["The quick brown fox jumps over the lazy dog again", "ÀÉ " * 14 + "x", "Ünï-" * 10, "y" * 40, "short line", "z" * 39 + "é"]
    rows = []
    for i in range(120):
        lines = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 6))]
        for line in common:
            if rng.random() < 0.3:
                lines.append(rng.choice(["", " ", "\t\r"]) + (line.upper() if line.isascii() and rng.random() < 0.3 else line) + rng.choice(["", " \x0b"]))
            if rng.random() < 0.1:
                lines += [line] * 3
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(200 + k, "only in four documents, whatever their order is\nx") for k in range(4)] + [(k, "in five documents, twice in one, whatever the order") for k in (210, 211, 212, 213)]
    rows += [(214, "in five documents, twice in one, whatever the order\n" * 2), (300, None), (301, ""), (302, "\n"), (303, "\n\n a \n"), (304, "w" * 300_000)]
    rows += [rows[5]] * 6 + [(None, rows[9][1])] * 2 + [(None, "a line that only rows without an id hold, five times")] * 5
    return rows


@pytest.mark.parametrize("most_bits,block_bytes", [(28, 4 << 20), (16, 500)])
def test_drop_repeated_lines(spark, rows, most_bits, block_bytes):
    held = texts()
    df = spark.createDataFrame([(i, t, "mine", -1, b"x", 2.5) for i, t in held], "doc_id long, text string, row string, n_lines int, digest binary, block double").repartition(4)
    got = line_dedup.drop_repeated_lines(df, most_bits=most_bits, block_bytes=block_bytes)
    assert rows(got, "doc_id", "n_lines", "n_dropped", "kept_sha256", "kept") == expected(held, 40, 5)
    assert set(got.columns) == {"doc_id", "row", "digest", "block", "n_lines", "n_dropped", "kept_sha256", "kept"}
    assert {(r.row, r.digest, r.block) for r in got.collect()} == {("mine", b"x", 2.5)}


def test_other_parameters(spark, rows):
    held = texts()
    df = spark.createDataFrame(held, "doc_id long, text string")
    got = line_dedup.drop_repeated_lines(df, least_chars=10, least_docs=3)
    assert rows(got, "doc_id", "n_lines", "n_dropped", "kept_sha256", "kept") == expected(held, 10, 3)
    with pytest.raises(ValueError):
        line_dedup.drop_repeated_lines(df, least_docs=1)


def test_empty(empty):
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    assert line_dedup.drop_repeated_lines(empty.limit(0)).columns[-1] == "kept"


def test_filter_suspects_what_repeats_and_little_else(spark):
    once = [f"line number {k} occurs in a single document only" for k in range(4000)]
    twice = [f"line number {k} occurs in two of the documents" for k in range(400)]
    df = spark.createDataFrame([("\n".join(once[k::40] + twice[k % 20::20]),) for k in range(40)], "text string").repartition(7)
    filter_ = line_dedup.twice_seen(df, "text", 17, 40)

    def share(lines):
        data = "\n".join(lines).encode()
        cut = line_dedup.lines_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 40)
        return line_dedup.suspected(filter_, cut.hashes(cut.long), 17).mean()

    assert share(twice) == 1 and share(once) < 0.02

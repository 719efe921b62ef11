"""Names searched by beginnings and endings, against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from rollbook.operators import name_trie, names
from test_names import edit_distance, written


@pytest.mark.parametrize("tails, branch, compared, seeds, block", [(1, 0, 3, 1, 7), (5, 3, 128, 4, 4096), (2048, 8, 128, 4, 4096)])
@pytest.mark.parametrize("limit", [names.FAR, 3, 1, 0])
def test_nearest_by_beginnings(monkeypatch, tails, branch, compared, seeds, block, limit):
    for key, value in {"TAILS": tails, "BRANCH": branch, "COMPARED": compared, "SEEDS": seeds, "BLOCK": block}.items():
        monkeypatch.setattr(name_trie, key, value)
    rng = random.Random(tails)
    held = list(dict.fromkeys(written(rng, 150) + ["", "a" * 70]))
    asked = written(rng, 60, most=18) + ["", "b" * 90, "a" * 69]
    far, which = name_trie.NameTrie(held).nearest(asked, np.full(len(asked), limit))
    for name, d, k in zip(asked, far, which):
        best = min((edit_distance(name, x), x) for x in held)
        assert (d, held[k]) == best if best[0] <= limit else k == -1


def test_branches_are_left_out_for_near_names(monkeypatch):
    monkeypatch.setattr(name_trie, "TAILS", 64)
    rng = random.Random(5)
    held = list(dict.fromkeys(written(rng, 3000, letters="abcdefgh", most=14)))
    held = [x for x in held if len(x) > 8]
    asked = sorted(x + "z" for x in held)[:40]
    trie = name_trie.NameTrie(held)
    far, _ = trie.nearest(asked, np.full(len(asked), names.FAR))
    assert (far == 1).all() and trie.measured < len(asked) * len(held) / 2


def test_both_searches_agree(spark):
    rng = random.Random(8)
    asked = spark.createDataFrame([(g, n) for g in "xy" for n in set(written(rng, 60))], "g string, n string")
    offered = spark.createDataFrame([(g, m, k) for g in "xz" for k, m in enumerate(sorted(set(written(rng, 80))))], "g string, m string, p int")
    by_beginnings, by_counts = (sorted(names.nearest(asked, offered, short=s, cell_names=30).collect()) for s in (100, -1))
    assert by_beginnings and by_beginnings == by_counts

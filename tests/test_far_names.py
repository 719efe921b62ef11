"""Names far from all others are found by comparing few of them."""

from __future__ import annotations

import random

import numpy as np
import pytest

from rollbook.operators import name_trie, names
from test_names import edit_distance, written


def syllables(rng, n):
    return "".join(rng.choice(("ma", "ri", "jo", "an", "pe", "lu", "ca", "to", "ni", "sa")) for _ in range(n))


def test_far_names_are_compared_with_few():
    rng = random.Random(6)
    held = list(dict.fromkeys(f"{syllables(rng, 4)} {syllables(rng, 3)}" for _ in range(6000)))
    asked = [x[::-1] for x in held[:60]] + [x + "nho" for x in held[60:90]]
    trie = name_trie.NameTrie(held)
    far, which = trie.nearest(asked, np.full(len(asked), names.FAR))
    assert far.max() >= 5 and trie.measured < len(asked) * len(held) / 4
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(asked)), np.arange(len(held)), indexing="ij"))
    d = names.edit_distances(names.Names(asked), names.Names(held), i, j).reshape(len(asked), -1)
    assert far.tolist() == d.min(axis=1).tolist()
    assert [held[k] for k in which] == [min(held[k] for k in np.flatnonzero(row == row.min())) for row in d]


@pytest.mark.parametrize("changed", [{"SEEDS": 0}, {"SEEDS": 0, "MEASURED": 1, "COLUMNS": 1}, {"SEEDS": 9, "KEPT": 20, "PLACES": 5}, {"COMPARED": 1, "TABLE": 1}])
def test_blocks_of_any_size(monkeypatch, changed):
    for key, value in changed.items():
        monkeypatch.setattr(name_trie, key, value)
    rng = random.Random(7)
    held, asked = sorted(set(written(rng, 120) + ["", "a" * 70])), written(rng, 40, most=20) + ["", "ab" * 40, "日本" * 9]
    limits = np.array([rng.choice([names.FAR, 7, 4, 1]) for _ in asked])
    far, which = name_trie.NameTrie(held).nearest(asked, limits)
    for name, limit, d, k in zip(asked, limits, far, which):
        best = min((edit_distance(name, x), x) for x in held)
        assert (d, held[k]) == best if best[0] <= limit else k == -1


def test_names_of_one_part_only():
    for held in (["a"], ["ab", "b"], ["x" * 9] * 1 + ["xy"], ["", "a"]):
        far, which = name_trie.NameTrie(held).nearest(["", "a", "xyx", "b" * 40], np.full(4, names.FAR))
        for name, d, k in zip(["", "a", "xyx", "b" * 40], far, which):
            assert (d, held[k]) == min((edit_distance(name, x), x) for x in held)

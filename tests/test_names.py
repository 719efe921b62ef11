"""The index of names against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from rollbook.operators import names


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def written(rng, n, letters="abcdeé日 ", most=14):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_edit_distances(monkeypatch):
    rng = random.Random(1)
    left, right = written(rng, 40) + ["a" * 400], written(rng, 50) + ["", "ab" * 150]
    i, j = np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij")
    want = [edit_distance(left[a], right[b]) for a, b in zip(i.ravel(), j.ravel())]
    for letters in (1 << 21, 50, 3000):
        monkeypatch.setattr(names, "LETTERS", letters)
        assert names.edit_distances(names.Names(left), names.Names(right), i.ravel(), j.ravel()).tolist() == want


def test_edit_distances_by_words(monkeypatch):
    rng = random.Random(9)
    left, right = [x for x in written(rng, 60, most=64) if x] + ["ab" * 32, "z"], written(rng, 50, most=90) + ["", "ab" * 150]
    tree = names.NameTree(right)
    i, j = np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij")
    want = [edit_distance(left[a], right[b]) for a, b in zip(i.ravel(), j.ravel())]
    for pairs in (1 << 15, 7):
        monkeypatch.setattr(names, "WORD_PAIRS", pairs)
        assert names.Words(names.Names(left), tree.alphabet, tree.ids, tree.held).distances(i.ravel(), j.ravel()).tolist() == want


def test_bounds_never_exceed_the_distance():
    rng = random.Random(2)
    left, right = written(rng, 60), written(rng, 60)
    a, b = names.Names(left).points(), names.Names(right).points()
    least = names.bounds(a, b, b)
    boxed = names.bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            assert boxed[i, 0] <= least[i, j] <= edit_distance(x, y)


@pytest.mark.parametrize("limit", [names.FAR, 3, 0])
def test_tree(monkeypatch, limit):
    rng = random.Random(3)
    monkeypatch.setattr(names, "PAIRS", 3000)
    held, asked = sorted(set(written(rng, 700))), written(rng, 150) + ["z" * 30, "", "ab" * 40]
    rng.shuffle(held)
    far, which = names.NameTree(held).nearest(asked, np.full(len(asked), limit))
    for name, d, k in zip(asked, far, which):
        best = min((edit_distance(name, m), m) for m in held)
        assert (d, held[k]) == best if best[0] <= limit else k == -1


def test_tree_measures_few_names():
    rng = random.Random(4)
    held = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 12))) for _ in range(8000)})
    tree = names.NameTree(held)
    asked = [x[:2] + x[3:] for x in held[::80]]
    far, _ = tree.nearest(asked, np.full(len(asked), names.FAR))
    assert far.max() <= 1 and tree.visited < 0.4 * len(asked) * len(tree.leaves)
    assert tree.measured < 0.05 * len(asked) * len(held)


@pytest.mark.parametrize("cell_names,task_names,most", [(8192, 50_000, None), (40, 25, None), (40, 25, 2)])
def test_nearest(spark, rows, cell_names, task_names, most):
    rng = random.Random(5)
    held = sorted({(g, m) for m in written(rng, 300) for g in rng.choice(["M", "F", "MF"])})
    asked = sorted({(g, m) for m in written(rng, 150) + ["x" * 25] for g in "MF"}) + [("?", "a")]
    got = names.nearest(
        spark.createDataFrame(asked, "g string, n string"), spark.createDataFrame([(g, m, k) for k, (g, m) in enumerate(held)], "g string, m string, p long"), most, cell_names, task_names,
    )
    want = []
    for g, n in asked:
        d, m, k = min(((edit_distance(n, m), m, k) for k, (h, m) in enumerate(held) if h == g), default=(99, None, None))
        if m is not None and (most is None or d <= most):
            want.append((g, n, d, m, k))
    assert rows(got, "g", "n", "d", "m", "p") == sorted(want, key=repr)


def test_nearest_of_nothing(spark):
    asked, offered = spark.createDataFrame([("M", "a")], "g string, n string"), spark.createDataFrame([("M", "b", 1)], "g string, m string, p long")
    assert names.nearest(asked, offered.filter("false")).count() == 0
    assert names.nearest(asked.filter("false"), offered).count() == 0


def test_equal_points_share_a_cell():
    points = names.Names(["ab"] * 50 + ["ba"] * 50 + ["xyz"]).points()
    nodes = names.cut(points, 7)
    cells = names.cells_of(points, nodes)
    assert len(set(cells[:100])) == 1 and 0 <= cells.min() and cells.max() < 7

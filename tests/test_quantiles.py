"""Quantiles of marks from mergeable sketches."""

from __future__ import annotations

import random

import numpy as np
import pytest

from rollbook.operators import reshape

PROBABILITIES = {"lowest": 0.0, "low": 0.1, "median": 0.5, "high": 0.95, "highest": 1.0}


def values(seed, n, grid):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.choice(["x", None]), rng.randint(-300, 2000) * grid if grid else rng.gauss(10, 4)) for _ in range(n)]


def quantiles(rows, key):
    out = {}
    for r in rows:
        out.setdefault(key(r), []).append(r[2])
    return {k: (np.quantile(v, list(PROBABILITIES.values())), len(v)) for k, v in out.items()}


@pytest.mark.parametrize("grid,error", [(0.25, 1e-9), (None, 0.125 + 1e-9)])
def test_quantiles_are_exact_on_the_grid_and_near_it_elsewhere(spark, grid, error):
    rows = values(1, 3000, grid) + [("c", "x", 7.5)]
    df = spark.createDataFrame([*rows, ("a", "x", None), ("a", "x", float("nan")), ("d", "x", None)], "g string, h string, value double").repartition(4)
    sketch = reshape.quantile_sketch(df, ["g", "h"], resolution=0.25)
    for by, key in ((["g", "h"], lambda r: r[:2]), (["g"], lambda r: r[:1]), (["h"], lambda r: r[1:2])):
        merged = reshape.merged_sketch(sketch, by)
        got = {tuple(r[c] for c in by): r for r in reshape.sketch_quantiles(merged, by, PROBABILITIES, 0.25).collect()}
        want = quantiles(rows, key)
        assert set(got) == set(want)
        for k, (q, n) in want.items():
            assert got[k].n_values == n
            assert max(abs(got[k][name] - x) for name, x in zip(PROBABILITIES, q)) <= error


def test_merging_parts_equals_the_whole(spark, rows):
    df = spark.createDataFrame(values(2, 800, 0.5), "g string, h string, value double")
    whole = reshape.quantile_sketch(df, ["g"])
    parts = [reshape.quantile_sketch(p, ["g", "h"]) for p in (df.filter("value < 100"), df.filter("value >= 100"))]
    assert rows(reshape.merged_sketch(parts[0].unionByName(parts[1]), ["g"])) == rows(whole)


def test_no_marks(spark):
    df = spark.createDataFrame([], "trimester int, subject string, district string, year int, value double")
    assert reshape.mark_quantiles(df).count() == 0

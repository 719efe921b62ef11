"""Operators on words against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollbook.llm import components, jaccard, repeats, rules, substrings, words as w

WORD = re.compile("[^\x20\x09-\x0D]+")


def test_words_of_arrow_columns():
    texts = ["a  bé\tc", None, "", "  ", "x\ny\x0bz", "one two"]
    data, offsets = w.text_buffers(pa.array(texts).slice(0))
    found = w.words_of(data, offsets)
    spelled = [bytes(found.data[a:b]).decode() for a, b in zip(found.starts, found.ends)]
    assert spelled == [x for t in texts if t for x in WORD.findall(t)]
    assert found.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    data, offsets = w.text_buffers(pa.chunked_array([texts[:2], texts[2:]]).slice(1, 4))
    assert w.words_of(data, offsets).counts.tolist() == [0, 0, 0, 3]


def test_hashes_depend_on_content_only():
    data, offsets = w.text_buffers(pa.array(["ab cd ab", "cd ab cd"]))
    found = w.words_of(data, offsets)
    h = found.hashes()
    assert h[0] == h[2] == h[4] and h[1] == h[3] == h[5] and h[0] != h[1]
    starts = found.windows(2)
    assert starts.tolist() == [0, 1, 3, 4]
    pairs = w.window_hashes(h, starts, starts + 2)
    assert pairs[0] == pairs[3] and pairs[1] == pairs[2] and pairs[0] != pairs[1]


def test_cover_has_every_difference():
    residues = substrings.COVER
    assert {(a - b) % substrings.PERIOD for a in residues for b in residues} == set(range(substrings.PERIOD))


def expected_removal(rows, window):
    spelled = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(x[s:s + window]) for x in spelled for s in range(len(x) - window + 1))
    out = []
    for (i, *_), x in zip(rows, spelled):
        gone = [False] * len(x)
        for s in range(len(x) - window + 1):
            if seen[tuple(x[s:s + window])] > 1:
                gone[s:s + window] = [True] * window
        kept = " ".join(a for a, g in zip(x, gone) if not g)
        out.append((i, len(x), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("block_bytes", [4 << 20, 4000])
def test_remove_repeats(docs, corpus, rows, monkeypatch, block_bytes):
    monkeypatch.setattr(repeats.dealt, "__defaults__", (block_bytes, 3 * block_bytes))
    got = substrings.remove_repeats(docs)
    want = expected_removal(corpus, 35)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted((x[:4] for x in want), key=repr)
    assert set(docs.columns) - {"text"} <= set(got.columns)
    text = {i: t for i, t, *_ in corpus}
    for r in got.collect():
        if r.doc_id is not None and r.n_removed == 0:
            assert r.kept == text[r.doc_id]
        elif r.n_removed:
            assert hashlib.sha256(" ".join(WORD.findall(r.kept)).encode()).hexdigest() == r.kept_sha256


def test_blocks_share_out_a_repeated_row(spark):
    text = "one text that a third of the table repeats " * 20
    rows = [(1, text)] * 1000 + [(k, f"{k} " + text) for k in range(2, 2002)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    blocks, _ = repeats.dealt(df, "text", block_bytes=len(text) * 100)
    counts = [r.n for r in blocks.filter("row.doc_id = 1").groupBy("block").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 31 and max(counts) < 70


def test_remove_repeats_of_empty(empty):
    assert substrings.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(empty, window=20)


def shingles(text):
    x = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(x[k:k + 5]) for k in range(len(x) - 4)} if len(x) >= 5 else ({tuple(x)} if x else set())


def expected_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    members = defaultdict(list)
    for k, r in enumerate(rows):
        members[find(k)].append(r[0])
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in members.items()}
    return sorted(((r[0], len(sets[k]), least[find(k)]) for k, r in enumerate(rows)), key=repr), len(members)


@pytest.mark.parametrize("half_from,tile,block_bytes", [(200, 4_000_000, 4 << 20), (40, 150, 4000)])
def test_near_copies(docs, corpus, rows, monkeypatch, half_from, tile, block_bytes):
    monkeypatch.setattr(repeats.dealt, "__defaults__", (block_bytes, 3 * block_bytes))
    monkeypatch.setattr(jaccard, "HALF_FROM", half_from)
    got = jaccard.near_copies(docs, carry=docs.columns, tile_shingles=tile)
    want, groups = expected_components(corpus)
    assert rows(got, "doc_id", "n_shingles", "component_id") == want
    assert got.filter("first").count() == groups
    assert set(docs.columns) <= set(got.columns)


def test_one_of_each(docs, corpus):
    got = jaccard.one_of_each(docs)
    want, groups = expected_components(corpus)
    kept = [r.doc_id for r in got.collect()]
    assert len(kept) == groups and got.columns == docs.columns
    assert {i for i in kept if i is not None} == {c for _, _, c in want if c is not None}


def test_near_copies_of_empty(empty):
    assert jaccard.near_copies(empty).count() == 0
    assert jaccard.one_of_each(empty).count() == 0


def test_count_tree_loses_no_link():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (20, 60, 300)]
    sets = []
    for b in base:
        for _ in range(40):
            keep = b[rng.random(len(b)) > 0.08]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, len(b) // 15).astype(np.uint64)])))
    limit = jaccard.Threshold(75)
    tree = jaccard.CountTree(np.array([len(s) for s in sets]), jaccard.count_points(sets))
    tested = 0
    for place in range(len(sets)):
        found = set(tree.search(place, limit).tolist())
        tested += len(found)
        for other in range(place + 1, len(sets)):
            if limit.linked(sets[tree.order[place]], sets[tree.order[other]]):
                assert other in found
    assert tested < len(sets) * (len(sets) - 1) // 2


@pytest.mark.parametrize("buckets", [1, 3, 1000, 12_000_000])
def test_published_rows_are_bounded_by_hashes(buckets):
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 1 << 64, 400, dtype=np.uint64) for _ in range(3)]
    parts += [parts[0][:100], parts[0][:7], np.array([0, (1 << 64) - 1, 0], dtype=np.uint64)]
    want = Counter(np.concatenate(parts).tolist())
    got, table = {}, repeats.entries(9, parts, buckets)
    assert table.num_rows <= min(buckets, len(want))
    assert table.column("bucket").to_pylist() == sorted(set(table.column("bucket").to_pylist()))
    for r in table.to_pylist():
        hashes, counts = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.uint32)
        assert r["block"] == 9 and {(int(h) >> 32) * buckets >> 32 for h in hashes} == {r["bucket"]}
        got |= dict(zip(hashes.tolist(), [*counts.tolist(), *[1] * (len(hashes) - len(counts))]))
    assert got == want
    assert repeats.entries(9, [], buckets).num_rows == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(31)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert got == want


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_SHARE", 6)
    edges = [(5000, k) for k in range(1000, 1600)] + [(k, k + 1) for k in range(1500, 1900)] + [(1, k) for k in range(6000, 6500)]
    edges += [(8000 + k, 8001 + k) for k in range(0, 100, 2)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 1000 for k in [*range(1000, 1901), 5000]} | {k: 1 for k in [1, *range(6000, 6500)]}
    assert got == want | {8000 + k: 8000 + k - k % 2 for k in range(100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def least_reachable(edges):
    root = {node: node for edge in edges for node in edge}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root |= {node: low for node, r in root.items() if r == high}
    return root


def test_a_tasks_edges_become_stars():
    rng = random.Random(3)
    edges = [(rng.randrange(300) * 7, rng.randrange(300) * 7) for _ in range(170)] + [(k + 1, k) for k in range(5000, 5400)] + [(9000, k) for k in range(8000, 8100)]
    a, b = np.array(edges).T
    node, root = components.stars(a, b)
    want = least_reachable(edges)
    assert dict(zip(node.tolist(), root.tolist())) == {k: r for k, r in want.items() if r != k} and len(node) == len(set(node.tolist()))
    assert not len(components.stars(a[:0], b[:0])[0])


def test_components_of_a_small_table_are_stored_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(components.session, "materialize", lambda df, label, f=components.session.materialize: (stored.append(label), f(df, label))[1])
    edges = [(k, k + 1) for k in range(400)] + [(900, k) for k in range(800, 850)] + [(None, 5), (4, 4)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(401)} | {k: 800 for k in [*range(800, 850), 900]}
    assert stored == ["component-edges"]


def test_components_over_several_chunks(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(components.session, "materialize", lambda df, label, f=components.session.materialize: (stored.append(label), f(df, label))[1])
    monkeypatch.setattr(components, "CHUNK", 5)
    monkeypatch.setattr(components, "HUB_SHARE", 6)
    rng = random.Random(4)
    edges = [(rng.randrange(300) * 3, rng.randrange(300) * 3) for _ in range(160)] + [(k, k + 1) for k in range(2000, 2150)] + [(5000, k) for k in range(2100, 2300)]
    edges = [(a, b) for a, b in edges if a != b] * 2
    with components.session.held(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "5"):
        got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(least_reachable(edges).items())
    assert "component-half" in stored


def test_least_neighbours_of_hubs_and_others(spark):
    edges = spark.createDataFrame([(1, k) for k in range(10, 1010)] + [(k, k + 1) for k in range(2000, 2050)], "u long, v long")
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    got = components._with_least(edges, least, edges.count())
    assert sorted(map(tuple, got.select("u", "v", "m").collect())) == sorted([(1, k, 10) for k in range(10, 1010)] + [(k, k + 1, k + 1) for k in range(2000, 2050)])


def expected_counts(text):
    text = text or ""
    x, symbols = WORD.findall(text), len(re.findall("[#*$%&|<>]", text))
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    grams = Counter(tuple(x[k:k + 8]) for k in range(len(x) - 7))
    covered = [False] * len(x)
    for k in range(len(x) - 7):
        if grams[tuple(x[k:k + 8])] > 1:
            covered[k:k + 8] = [True] * 8
    n = sum(covered)
    return len(x), sum(map(len, x)), symbols, repeated, n, len(x) < 20 or 100 * n > 30 * len(x)


def test_rules(docs, corpus, rows, spark, empty):
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(None, 1), (50, None)], "doc_id long, label int")
    got = rules.judge(docs, labels)
    want = sorted(((i, *expected_counts(t)) for i, t, *_ in corpus), key=repr)
    assert rows(got, "doc_id", *rules.COUNTS, "base_failed") == want
    assert got.filter("kept and base_failed").count() == 0
    assert rules.judge(empty, labels).count() == 0
    none = labels.filter("false")
    assert rules.judge(docs, none).filter("kept = base_failed").count() == 0


def test_rules_repeated_lines(spark, rows):
    texts = ["a b\nc d\na b\n\n\na b", "x\n x\nx ", "same\nsame", "\n", "a b\r\na b\r\na b"]
    got = rules.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r[1:] for r in rows(got, "doc_id", *rules.COUNTS, "base_failed")] == [expected_counts(t) for t in texts]


def test_forest_isolates_the_odd_one():
    points = np.concatenate([np.random.default_rng(1).normal(0, 1, (200, 3)), [[30, 30, 30]]])
    forest = [rules.grow(points, np.random.default_rng(t), 8) for t in range(50)]
    assert rules.paths(points, forest).argmin() == 200

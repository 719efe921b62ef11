"""Mixing, packing, sharding, token files, lists over time, search and the classifier."""

from __future__ import annotations

import math
import re
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook import session
from rollbook.llm import classifier, mixing, packing, prefix, queries, sharding, token_files, tokens, topk, url_lists

FOLDER = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not FOLDER.exists(), reason="generated tables are absent")


def words(text):
    return len(re.findall("[^\x20\x09-\x0D]+", text or ""))


def water(sizes, weights, cap):
    total, level, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in full]
        rest = total - sum(cap * sizes[k] for k in full)
        share = {k: rest * weights[k] / sum(weights[j] for j in free) for k in free}
        over = {k for k in free if share[k] > cap * sizes[k]}
        if not over:
            return [share.get(k, cap * sizes[k]) for k in range(len(sizes))]
        full |= over


def test_mix(docs, corpus):
    mixed = mixing.mix(docs, F.col("source"), prefix.word_count(F.col("text")))
    assert set(docs.columns) <= set(mixed.columns)
    got = mixed.collect()
    assert len(got) == len(corpus)
    names = sorted({s for *_, s in corpus if s is not None}) + [None]
    sizes = [sum(words(t) for _, t, s in corpus if s == name) for name in names]
    goals = water(sizes, [1 + k % 3 for k in range(len(names))], 3)
    for name, size, goal in zip(names, sizes, goals):
        own = [r for r in got if r.source == name]
        assert {r.source_size for r in own} == {size}
        assert abs(own[0].target - goal) < 0.01
        assert abs(sum(r.taken for r in own) - goal) <= max(0.02 * goal, 3)
    assert all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in got)
    assert sorted((r.doc_id or -1, r.copies) for r in got) == sorted((r.doc_id or -1, r.copies) for r in mixed.collect())


def test_mix_caps_a_small_source(spark):
    rows = [("a", 10)] * 2 + [("b", 100)] * 40 + [("c", 100)] * 40 + [("d", 0)]
    df = spark.createDataFrame(rows, "source string, words long")
    got = mixing.mix(df, F.col("source"), F.col("words"), (50, 1, 1)).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    by = {r.source: (r.target, r.taken) for r in got}
    assert by["a"] == (60, 60) and by["d"] == (0, 0)
    assert abs(by["b"][0] - 3980) < 0.01 and abs(by["b"][1] - 3980) <= 50 and abs(by["c"][1] - 3980) <= 50


def test_mix_of_empty(empty):
    assert mixing.mix(empty, F.col("source"), F.col("n_chars")).count() == 0


def test_shards(docs, corpus, empty):
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    cut = sharding.shard(docs, size, [F.col("doc_id"), F.crc32(F.col("text").cast("binary"))], 5)
    got = sorted(cut.collect(), key=lambda r: (r.shard, r.slot))
    assert len(got) == len(corpus)
    sizes = [len((t or "").encode()) + 8 for _, t, _ in corpus]
    bytes_, largest = [0] * 5, max(sizes)
    for k in range(5):
        own = [r for r in got if r.shard == k]
        assert [r.slot for r in own] == list(range(len(own)))
        bytes_[k] = sum(r.size for r in own)
    assert sum(bytes_) == sum(sizes) and max(abs(b - sum(sizes) / 5) for b in bytes_) <= largest
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert sharding.shard(empty, F.lit(1), [F.col("doc_id")], 5).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 31])
def test_bit_fields(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == 4 * bits * -(-len(ids) // 32)
    for start, count in ((0, 1000), (0, 0), (31, 2), (517, 100), (999, 1)):
        assert token_files.unpack(packed, bits, start, count).tolist() == ids[start: start + count].tolist()


def test_an_id_beyond_its_bits_is_an_error():
    with pytest.raises(ValueError, match="70000"):
        token_files.pack(np.array([1, 70_000], np.uint32), 16)
    assert token_files.unpack(token_files.pack(np.array([65_535], np.uint32), 16), 16, 0, 1).tolist() == [65_535]


def tilted(pairs, goal, cap):
    """Rates of an independent solver: the one multiplier of a source by bisection."""
    mean = sum(n * s for s, n in pairs) / sum(n for _, n in pairs)
    low, high = -1e4, 1e4

    def got(m):
        return sum(n * s * min(cap, math.exp(min(50, m * s / mean))) for s, n in pairs)

    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if got(middle) < goal else (low, middle)
    return {s: min(cap, math.exp(min(50, low * s / mean))) for s, _ in pairs}


def test_rates_are_those_of_an_independent_solver(spark):
    rng = np.random.default_rng(4)
    rows = [(str(k % 3), int(s)) for k, s in enumerate(rng.lognormal(4, 1, 900).astype(int) + 1)]
    got = mixing.mix(spark.createDataFrame(rows, "source string, words long"), F.col("source"), F.col("words")).collect()
    for name in "012":
        own = [r for r in got if r.source == name]
        pairs = [(int(s), n) for s, n in zip(*np.unique([r.size for r in own], return_counts=True))]
        want = tilted(pairs, own[0].target, 3)
        assert max(abs(r.rate - want[r.size]) for r in own) < 1e-3


def test_unsolved_rates_are_told(spark):
    cells = spark.createDataFrame([(False, "a", 10, 5), (False, "a", 30, 2)], "src_null boolean, src string, size long, n long")
    goals = spark.createDataFrame([(False, "a", 110, 7, 10, 200.0)], "src_null boolean, src string, tokens long, docs long, least long, target double")
    with pytest.warns(UserWarning, match="after 1 Newton"):
        mixing.multipliers(cells, goals, 3, most=1)


@pytest.mark.parametrize("name,as_words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_are_those_of_the_whole_text(corpus, name, as_words):
    encoder = tokens.Encoder(queries.tokenizer(name), as_words)
    texts = [t for _, t, _ in corpus if t] + ["It's 'sun' we'll", "  two  spaces", "tab\tin", "trail \n", "naïve café.\nNew", "日本語。 文 字", "a\x1cb \x1c c", "x́ y", "<|endoftext|> a", "éÉ ŒœŸ", "12 3,4.5"]
    for text in texts:
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, text
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, text


def test_token_files(spark, docs, corpus, empty):
    path = session.new_shared_path(spark, "test-files")
    name = queries.tokenizer("byte_bpe_50k.json")
    token_files.write(docs, path, name, 2, 50_257, block_ids=1000)
    got = token_files.documents(token_files.read(spark, path)).collect()
    encoder = tokens.Encoder(name, False)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    crc = [(-1 if i is None else i, zlib.crc32(encoder.encode(t) + np.array([2], "<u4").tobytes())) for i, t, _ in corpus]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == sorted(crc)
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)
    path = session.new_shared_path(spark, "test-files")
    token_files.write(empty, path, name, 2, 50_257)
    assert token_files.documents(token_files.read(spark, path)).count() == 0


def test_packing(docs, corpus, empty):
    name = queries.tokenizer("word_bpe_49k.json")
    got = packing.pack_documents(docs, name, 1, 256).collect()
    encoder = tokens.Encoder(name, True)
    want = []
    for i, t, _ in corpus:
        ids = encoder.encode(t) + np.array([1], "<u4").tobytes()
        want += [(i, k, a // 4, len(ids[a: a + 1024]) // 4, zlib.crc32(ids[a: a + 1024])) for k, a in enumerate(range(0, len(ids), 1024))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[:5])) for r in got)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    least = packing.least_sequences([r.length for r in got], 256)
    assert -(-sum(r.length for r in got) // 256) <= least <= len(held) <= 1.02 * least
    assert packing.pack_documents(empty, name, 1, 256).count() == 0


def test_packing_reads_texts_in_small_batches(docs, spark, monkeypatch):
    found, store = {}, session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, label: found.setdefault(label, spark.conf.get(session._BATCH, None)) and None or store(df, label))
    before = spark.conf.get(session._BATCH, None)
    packing.pack_documents(docs, queries.tokenizer("word_bpe_49k.json"), 1, 256)
    assert found["pack-pieces"] == str(session.BATCH_BYTES) and found["pack-islands"] == before
    assert spark.conf.get(session._BATCH, None) == before


def test_a_worker_drops_its_encoders():
    name = queries.tokenizer("word_bpe_49k.json")
    ids = tokens.encoder(name, True).encode("Two words")
    tokens.forget()
    assert not tokens._encoders and tokens.encoder(name, True).encode("Two words") == ids


def test_least_sequences():
    rng = np.random.default_rng(4)
    for _ in range(200):
        lengths = rng.integers(1, 20, rng.integers(1, 9)).tolist()
        best = len(lengths)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(lengths):
                best = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + lengths[k] <= 20:
                    place(k + 1, bins[:j] + [bins[j] + lengths[k]] + bins[j + 1:])
            place(k + 1, bins + [lengths[k]])

        place(0, [])
        assert -(-sum(lengths) // 20) <= packing.least_sequences(lengths, 20) <= best


def test_genetic_search_improves_on_best_fit():
    rng = np.random.default_rng(0)
    # Triples that fill a sequence exactly; best fit by decreasing length misses them.
    cuts = [sorted(rng.integers(250, 500, 2).tolist()) for _ in range(40)]
    lengths = sorted((x for a, b in cuts for x in (a, b, 1000 - a - b)), reverse=True)
    first = packing.decreasing(lengths, list(range(len(lengths))), 1000)
    best = packing.evolve(lengths, packing.founders(lengths, [first], 1000, rng), 1000, rng, 40)[0]
    assert sorted(i for b in best for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 1000 for b in best)
    assert packing.fitness(best, lengths, 1000) > packing.fitness(first, lengths, 1000)


def test_islands_exchange_elites(spark):
    rng = np.random.default_rng(1)
    cuts = [sorted(rng.integers(250, 500, 2).tolist()) for _ in range(60)]
    lengths = [int(x) for a, b in cuts for x in (a, b, 1000 - a - b)]
    items = spark.createDataFrame(list(enumerate(lengths)), "at long, length long")
    got = packing.pack(items, 1000, block_pieces=90).collect()
    assert sorted(r["at"] for r in got) == list(range(len(lengths)))
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + lengths[r["at"]]
    assert max(fill.values()) <= 1000


def test_a_block_at_its_bound_has_a_generation(spark, monkeypatch):
    calls, stored, cross, store = [], {}, packing.cross, session.materialize
    monkeypatch.setattr(packing, "cross", lambda *a: calls.append(1) or cross(*a))
    lengths, rng = [6, 6, 4, 4], np.random.default_rng(0)
    population = packing.founders(lengths, [[[0, 2], [1, 3]]], 10, rng)
    assert len(packing.evolve(lengths, population, 10, rng, 6)[0]) == 2
    assert len(calls) == packing.POPULATION
    monkeypatch.undo()

    def count(df, label):
        out = store(df, label)
        stored.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(session, "materialize", count)
    items = spark.createDataFrame(list(enumerate(lengths)), "at long, length long")
    got = packing.pack(items, 10)
    assert got.select("sequence_id").distinct().count() == 2 and got.count() == 4
    assert stored["pack-islands"] == [packing.ISLANDS] * packing.ROUNDS


def test_domains_above_a_very_long_host(spark, tmp_path):
    pages = [(1, "http://evil.org/x"), (2, "https://sub.evil.org/"), (3, "http://" + "a." * 200 + "evil.org/y")] + [(k, f"https://fine{k}.org/") for k in range(4, 60)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = queries.QUERIES["op5_url_lists"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES['op5_url_lists']})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted(want)
    assert [r[4] for r in sorted(got)][:3] == [False, False, True]


def test_lists_over_time(spark, rows):
    entries = spark.createDataFrame([
        ("a", "evil.org", 10, True), ("a", "evil.org", 20, False), ("a", "evil.org", 20, True), ("a", "evil.org", 30, False),
        ("b", "x.net/ads", 5, True), ("b", None, 5, True), ("b", "z.net", None, True), ("c", "sub.evil.org", 12, True),
    ], "list string, key string, day int, listed boolean")
    seen = [("http://evil.org/p", 9), ("HTTP://EVIL.ORG", 10), ("https://user@sub.evil.org:80/", 12), ("http://evil.org", 29), ("http://evil.org", 30), ("http://notevil.org", 15), ("http://x.net/ads/1", 99), ("http://x.net/ad", 99), (None, 10), ("evil.org", 10), ("http://evil.org", None), ("http://" + "a." * 200 + "evil.org", 15), ("http://evil.org", 29)]
    captures = spark.createDataFrame([(k, u, d, "mine") for k, (u, d) in enumerate(seen)], "nr long, url string, day int, lists string")
    got = url_lists.active(captures, F.col("url"), F.col("day"), entries)
    want = ["", "a", "a,c", "a", "", "", "b", "", "", "", "", "a", "a"]
    assert [r[1] for r in rows(got, "nr", "lists")] == [want[k] for k in sorted(range(len(want)), key=lambda k: repr((k,)))]
    assert got.filter("blocked <> (n_active > 0)").count() == 0
    assert url_lists.active(captures, F.col("url"), F.col("day"), entries.filter("false")).filter("blocked").count() == 0
    assert url_lists.active(captures.filter("false"), F.col("url"), F.col("day"), entries).count() == 0


def test_a_host_of_a_megabyte(spark):
    entries = spark.createDataFrame([("a", "evil.org", 10, True), ("b", "x.y.z.evil.org", 10, True)], "list string, key string, day int, listed boolean")
    hosts = ["a." * 500_000 + "evil.org", "a." * 500_000 + "x.y.z.evil.org", "a." * 500_000 + "fine.org", "b" * 1_000_000]
    captures = spark.createDataFrame([(k, f"http://{h}/p", 15) for k, h in enumerate(hosts)], "nr int, url string, day int")
    begun = time.perf_counter()
    got = url_lists.active(captures, F.col("url"), F.col("day"), entries).select("nr", "lists").sort("nr").collect()
    assert [r.lists for r in got] == ["a", "a,b", "", ""]
    assert time.perf_counter() - begun < 30


@pytest.mark.parametrize("shard_rows,task_queries", [(16_384, 512), (100, 7), (30, 3)])
def test_top_k(spark, shard_rows, task_queries):
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (400, 8))
    x[200:260] = x[100]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(400, None), (401, [None] * 8), (None, [1] * 8), (402, [1, 2])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 5, shard_rows, task_queries).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        s = x @ x[q]
        best = [k for k in np.lexsort((np.arange(400), -s)) if k != q][:5]
        assert sorted(found) == [(n + 1, k, s[k]) for n, k in enumerate(best)]


def clustered(n, dim=16, groups=32, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    middle = 4000 * middle / np.sqrt((middle ** 2).sum(axis=1))[:, None]
    return np.rint(middle[rng.integers(0, groups, n)] + rng.normal(0, 60, (n, dim)))


def test_branches_of_clustered_vectors_are_cut():
    x = clustered(8192)
    tree = topk.BallTree(np.arange(len(x)), np.arange(len(x)), x)
    asked = range(0, len(x), 64)
    for q in asked:
        ids, scores = tree.search(x[q], q, float("-inf"), 5)
        s = x @ x[q]
        best = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != q][:5]
        assert ids.tolist() == best and scores.tolist() == s[best].tolist()
    assert tree.opened < 0.2 * len(asked) * len(tree.leaves)


def test_cells_that_cannot_reach_the_kth_score_are_not_visited(spark):
    x = clustered(4000)
    store = spark.createDataFrame([(k, k, 16, v.tolist()) for k, v in enumerate(x.astype(int))], "at long, vec_id long, dim int, vector array<long>")
    cells = topk.fit_cells(store, 128)[16]
    cell, away = cells.place(x)
    assert len(cells.centres) == 32 and np.bincount(cell).max() < 1000
    for c in np.unique(cell):
        cells.radii[c] = away[cell == c].max()
    queries = x[::100]
    bounds, scores = cells.bounds(queries), queries @ x.T
    for c in np.unique(cell):
        assert (bounds[:, [c]] >= scores[:, cell == c]).all()
    kth = np.sort(scores, axis=1)[:, -5]
    assert (bounds >= kth[:, None]).mean() < 0.3
    assert topk.fit_cells(store, 4000) == {} and topk.fit_cells(store.filter("false"), 1) == {}


def test_top_k_with_most_rows_equal_and_many_lengths(spark):
    x = [[1, 2, 3]] * 300 + [[k % 7, -k, k % 5] for k in range(300)] + [[k] for k in range(40)] + [[]] * 3
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "vec_id long, vector array<int>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 60 == 0, 5, 50, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 643, 60))
    for q, found in got.items():
        scores = [(-sum(a * b for a, b in zip(x[q], v)), k) for k, v in enumerate(x) if k != q and len(v) == len(x[q])]
        assert sorted(found) == [(n + 1, k, -s) for n, (s, k) in enumerate(sorted(scores)[:5])]


def test_top_k_among_equal_ids(spark, rows):
    df = spark.createDataFrame([(0, [1, 2]), (0, [5, 5]), (1, [3, 4])], "vec_id long, vector array<long>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5)
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted([(0, 1, 0, 15), (0, 2, 1, 11), (0, 1, 1, 35), (0, 2, 0, 15)])


def test_top_k_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [0, -1])], "vec_id long, vector array<long>")
    got = topk.top_k(df, F.col("vec_id") == 0, 5).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 11), (2, 2, -2)]
    assert topk.top_k(df.filter("false"), F.lit(True), 5).count() == 0


def test_classifier(spark, docs, corpus, empty):
    good = [(i, t, 1) for i, t, _ in corpus[:60]]
    bad = [(1000 + i, " ".join(x + "%%%" for x in (t or "").split()), 0) for i, t, _ in corpus[:60]]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, label int")
    train, held = df.filter("doc_id % 3 > 0"), df.filter("doc_id % 3 = 0")
    weights = classifier.fit(train, train.select("doc_id", "label"))
    got = classifier.score(held, weights).collect()
    long_ones = [r for r in got if words(r.text) > 10]
    assert sum((r.score >= 0.5) == r.label for r in long_ones) >= 0.95 * len(long_ones)
    scored = classifier.score(docs, weights)
    assert scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert scored.count() == len(corpus) and set(docs.columns) <= set(scored.columns)
    assert classifier.score(empty, weights).count() == 0
    untaught = classifier.fit(train, train.select("doc_id", "label").filter("false"))
    assert not untaught.any()


def test_one_id_cannot_fill_the_sample(spark):
    texts = [(0, f"text number {k} of one id") for k in range(2000)] + [(0, "the same")] * 500 + [(k, f"own text {k}") for k in range(1, 40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] * 2, "doc_id long, label int")
    held = classifier._learn_rows(df, labels, 200)
    assert 100 <= held.count() <= 300
    whole = classifier._learn_rows(df, labels, 5000)
    assert whole.count() == 2040
    assert classifier.fit(df, labels, 200).any()


@needs_tables
def test_pipeline(spark, empty):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, str(FOLDER))
    assert packed.count() > 0 and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    none = empty.select(*corpus_pipeline.DOCUMENT)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(FOLDER)).count() == 0


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(FOLDER))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, want))


@needs_tables
def test_other_queries_run(spark):
    counts = {"op1_mixing": 200, "op2_packing": 200, "op3_classifier": 200, "op8_token_files": 200, "op10_rules": 200}
    for name, least in counts.items():
        assert queries.QUERIES[name](spark, str(FOLDER)).count() >= least

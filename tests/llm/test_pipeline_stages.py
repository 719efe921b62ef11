"""Every stage of the pipeline against plain Python: nulls, copies, ties, long texts, clashing columns."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from test_table_operators import water, words
from test_text_operators import expected_components, expected_removal

import corpus_pipeline
from rollbook.llm import queries, tokens

DOCUMENT = corpus_pipeline.DOCUMENT


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    """Labels: texts of the corpus are good, the same texts with signs between the words are bad."""
    path = str(tmp_path_factory.mktemp("labels"))
    labels = [(i, 1, 0) for i, _, _ in corpus[:60]] + [(1000 + i, 0, 0) for i, _, _ in corpus[:60]] + [(None, 1, 0), (3, None, 0)]
    spark.createDataFrame([x for x in labels if x[0] is None or x[0] % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def bad_of(corpus):
    return [(1000 + i, " ".join(x + "%%%" for x in (t or "").split()), s) for i, t, s in corpus[:60]]


def as_documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), -1, "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size long, row string").repartition(3)


def test_quality_keeps_good_documents(spark, corpus, folder):
    kept = corpus_pipeline.keep_quality(spark, as_documents(spark, corpus + bad_of(corpus)), folder)
    assert kept.columns == DOCUMENT
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    for i, t, _ in corpus:
        if words(t) > 10 and i is not None and i < 60:
            assert got[i, t] == sum((i, t) == (j, u) for j, u, _ in corpus)
    assert not [i for i, t, _ in bad_of(corpus) if words(t) > 10 and got[i, t]]


def test_near_copies_leave_one_of_each_group(spark, corpus, folder):
    got = corpus_pipeline.drop_near_copies(spark, as_documents(spark, corpus), folder).collect()
    want, groups = expected_components(corpus)
    assert len(got) == groups and {r.doc_id for r in got if r.doc_id is not None} == {c for *_, c in want if c is not None}
    whole = {(i, t, s) for i, t, s in corpus}
    assert all((r.doc_id, r.text, r.source) in whole and r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_repeated_text_goes_and_the_rest_is_unchanged(spark, corpus, folder):
    got = corpus_pipeline.drop_repeated_text(spark, as_documents(spark, corpus), folder)
    assert got.columns == DOCUMENT
    text = Counter()
    for (i, n, removed, _, kept), (_, t, s) in zip(expected_removal(corpus, 35), corpus):
        text[i, kept if removed else None, None if removed else t, s] += 1
    found = Counter()
    for r in got.collect():
        untouched = any(r.text == t and r.doc_id == i and not x[2] for x, (i, t, _) in zip(expected_removal(corpus, 35), corpus))
        found[r.doc_id, None if untouched else " ".join(r.text.split()), r.text if untouched else None, r.source] += 1
        assert r.n_chars == (None if r.text is None else len(r.text))
    spaced = Counter({(i, k if k is None else " ".join(k.split()), t, s): n for (i, k, t, s), n in text.items()})
    assert found == spaced


def test_mix_repeats_documents_towards_the_targets(spark, corpus, folder):
    got = corpus_pipeline.mix_sources(spark, as_documents(spark, corpus), folder).collect()
    names = sorted({s for *_, s in corpus if s is not None}) + [None]
    sizes = [sum(words(t) for _, t, s in corpus if s == name) for name in names]
    for name, goal in zip(names, water(sizes, [1 + k % 3 for k in range(len(names))], 3)):
        assert abs(sum(words(r.text) for r in got if r.source == name) - goal) <= max(0.02 * goal, 3)
    have, given = Counter((r.doc_id, r.text, r.source) for r in got), Counter(corpus)
    assert set(have) <= set(given) and all(n <= 3 * given[k] for k, n in have.items())
    assert all(have[k] == n for k, n in given.items() if not words(k[1]))


def test_packed_pieces_are_the_documents(spark, corpus, folder):
    rows = [*corpus, (5000, " ".join(t or "" for _, t, _ in corpus) * 2, "s1")]
    got = corpus_pipeline.pack_sequences(spark, as_documents(spark, rows).select(*DOCUMENT), folder).collect()
    encoder, want = tokens.Encoder(queries.tokenizer("word_bpe_49k.json"), True), []
    for i, t, _ in rows:
        ids = encoder.encode(t) + np.array([1], "<u4").tobytes()
        want += [(i, k, a // 4, len(ids[a: a + 4 * 4096]) // 4, zlib.crc32(ids[a: a + 4 * 4096])) for k, a in enumerate(range(0, len(ids), 4 * 4096))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096

"""The source audit against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rollbook.llm import divergence, words as w

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(rows, least_docs, top):
    rows = [(lang or "", source or "", terms(text)) for lang, source, text in rows]
    docs = Counter((lang, t) for lang, _, x in rows for t in set(x))
    kept = defaultdict(set)
    for (lang, t), n in docs.items():
        if n >= least_docs:
            kept[lang].add(t)
    held, whole = defaultdict(Counter), defaultdict(Counter)
    for lang, source, x in rows:
        own = [t for t in x if t in kept[lang]]
        held[lang, source].update(own)
        whole[lang].update(own)

    def share(counts, lang, t):
        return 1 + (10**9 * (counts[t] + 5)) // (sum(counts.values()) + 5 * len(kept[lang]))

    out = []
    for lang, source in held:
        counts = held[lang, source]
        pairs = [(sum(abs(share(counts, lang, t) - share(held[lang, o], lang, t)) for t in kept[lang]), o) for k, o in held if k == lang and o != source]
        own = [(share(counts, lang, t) - share(whole[lang], lang, t), t) for t in kept[lang] if counts[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", [x for x in own if x[0] > 0], top)):
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, n) for n, (value, item) in enumerate(found, 1)]
    return sorted(out, key=repr)


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def documents():
    rng = random.Random(6)
    vocabulary = ["alpha", "Beta", "gamma", "DELTA", "été", "naïve", "日本", "x", "don't", "z9z", "Ünder", "ß"] + [f"w{c}" for c in "abcdefghij"]
    rows = []
    for _ in range(240):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "s2", "Ä", "", None])
        bias = vocabulary[(hash_of(source) % 5):]
        rows.append((lang, source, rng.choice([" ", "\n", "--"]).join(rng.choice(bias) for _ in range(rng.randint(0, 25)))))
    rows += [rows[3]] * 9 + [("en", "s1", rows[3][2]), ("en", "s7", rows[3][2]), ("de", None, rows[3][2])]
    rows += [("en", "quiet", None), ("en", "quiet", ""), ("fr", "one", "seul"), ("fr", "two", "123 #"), ("it", "only", "a b c"), (None, None, None)]
    return rows + [("en", "long", " ".join(rng.choice(vocabulary) for _ in range(40_000)))]


def hash_of(source):
    return sum(map(ord, source or "-"))


@pytest.mark.parametrize("least_docs,top,sizes", [(30, 50, ()), (3, 4, (2, 8, 3)), (1000, 5, (1, 1, 1))])
def test_audit(spark, rows, least_docs, top, sizes):
    held = documents()
    df = spark.createDataFrame([(k, *r, "mine", -1) for k, r in enumerate(held)], "doc_id long, lang string, source string, text string, term string, number int").repartition(5)
    got = divergence.audit(df, least_docs=least_docs, top=top, **dict(zip(("block_sources", "bucket_counts", "matrix_terms"), sizes)))
    assert rows(got, *COLUMNS) == expected(held, least_docs, top)
    assert got.columns == list(COLUMNS)


def test_audit_of_empty(spark, empty):
    assert divergence.audit(empty).count() == 0


def test_large_counts_stay_exact(spark):
    n = 9 * 10**12 + 7
    df = spark.createDataFrame([(n, 3 * n + 1, 12_345)], "n long, total long, terms long")
    got = df.select(divergence._share(df.n, df.total, df.terms)).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (3 * n + 1 + 5 * 12_345)


@pytest.mark.parametrize("held,spread", [(1 << 19, 1 << 21), (40, 7)])
def test_counts_of_a_task(monkeypatch, held, spread):
    monkeypatch.setattr(divergence, "HELD_COUNTS", held)
    monkeypatch.setattr(divergence, "SPREAD_COUNTS", spread)
    rows = [("en", [{"source": f"s{j}", "n": 1 + (j + k) % 3} for j in range(1 + k % 7)], f"a b{'cdefgh'[k % 6]} a a É") for k in range(60)]
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[2] for r in rows], "sources": [r[1] for r in rows]})
    docs, counts = Counter(), Counter()
    for part in divergence._count(iter([batch.slice(0, 25), batch.slice(25)])):
        for r in part.to_pylist():
            docs[r["lang"], r["term"]] += r["docs"]
            for s, n in zip(r["sources"], r["counts"]):
                counts[r["lang"], s, r["term"]] += n
    want_docs, want = Counter(), Counter()
    for lang, sources, text in rows:
        for t in set(terms(text)):
            want_docs[lang, t] += sum(s["n"] for s in sources)
        for s in sources:
            for t in terms(text):
                want[lang, s["source"], t] += s["n"]
    assert docs == want_docs and counts == want


def test_terms_are_runs_of_letters():
    text = "Ab1cd_É-z\x7f日本 [x]"
    data, offsets = w.text_buffers(pa.array([text]))
    found = w.words_of(data, offsets, upper_to_lower=True, separator=divergence.NO_TERM)
    assert [found.data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends)] == terms(text)
    assert np.array_equal(found.counts, [6])

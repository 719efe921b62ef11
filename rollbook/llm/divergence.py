"""How the sources of a language differ in their words.

Identical texts of a language are collapsed into one row that knows how often each source
holds it; each such text is split into terms once, and its counts enter with these numbers.
Document frequencies decide which terms stay. Sources are then compared over terms that
occur in them only: for all other terms the difference of two sources is the same, and is
added in one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollbook import session
from rollbook.llm import words as w

#: Terms are runs of letters A-Z, a-z and of all characters beyond ASCII.
NO_TERM = np.ones(256, dtype=bool)
NO_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Fixed values of the smoothed share of a term: 1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)).
SCALE = 1_000_000_000
ADDED = 5

#: Counts that a task holds before it hands them on, counts spread out at once, sources of a
#: block, counts of a bucket of terms (average), and terms of a matrix.
HELD_COUNTS = 1 << 19
SPREAD_COUNTS = 1 << 21
BLOCK_SOURCES = 256
BUCKET_COUNTS = 1 << 16
MATRIX_TERMS = 2048

_COUNTED = "lang string, term string, docs long, sources array<string>, counts array<bigint>"


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], *(np.add.reduceat(v[order], begins) if len(keys) else v for v in values)


class _Counter:
    """Counts of (term, group) of many texts; a group is a language and a source."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.spelled: dict[int, bytes] = {}
        self.size = 0

    def add(self, langs: list[str], sources: list[list[dict]], found: w.Words) -> None:
        """Terms of some texts, each with its language and [{source, n}, ...]."""
        many = np.array([len(s) for s in sources])
        owners = np.array([self.groups.setdefault((lang, s["source"]), len(self.groups)) for lang, of in zip(langs, sources) for s in of], np.int64)
        times = np.array([s["n"] for of in sources for s in of], np.int64)
        begins = np.concatenate([[0], np.cumsum(many)])
        hashes, text = found.hashes(), found.texts_of_words()
        order = np.argsort(hashes, kind="stable")  # words of one term stay in the order of texts
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        term, text, n = hashes[at], text[at], np.diff(np.append(at, len(hashes)))
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = term[1:] != term[:-1]
        for h, k in zip(term[fresh].tolist(), order[at[fresh]].tolist()):
            if h not in self.spelled:
                self.spelled[h] = found.data[found.starts[k]: found.ends[k]].tobytes()
        # Every source of the text gets the text's counts as often as it holds it.
        total = np.cumsum(many[text])
        place, done = 0, 0
        while place < len(term):
            end = max(place + 1, int(np.searchsorted(total, done + SPREAD_COUNTS, side="right")))
            repeats = many[text[place:end]]
            entry = np.repeat(np.arange(place, end), repeats)
            within = np.arange(len(entry)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
            by = begins[text[entry]] + within
            self._hold(term[entry], owners[by], n[entry] * times[by], times[by])
            place, done = end, int(total[end - 1])

    def _hold(self, term: np.ndarray, owner: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.parts.append(self._merged([(term, owner, n, docs)]))
        self.size += len(self.parts[-1][0])
        if self.size > 2 * HELD_COUNTS:
            self.parts = [self._merged(self.parts)]
            self.size = len(self.parts[0][0])

    @staticmethod
    def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        term, owner, n, docs = (np.concatenate(x) for x in zip(*parts))
        known, number = np.unique(term, return_inverse=True)
        span = int(owner.max(initial=0)) + 1
        key, n, docs = _sums(number * span + owner, n, docs)
        return known[key // span], key % span, n, docs

    @property
    def full(self) -> bool:
        return self.size > HELD_COUNTS

    def result(self) -> pa.RecordBatch:
        """One row for each language and term: its documents, and the counts by source."""
        term, owner, n, docs = self._merged(self.parts)
        names = list(self.groups)
        numbers: dict[str, int] = {}
        lang_of = np.array([numbers.setdefault(lang, len(numbers)) for lang, _ in names], np.int64)
        order = np.lexsort((owner, term, lang_of[owner]))
        term, owner, n, docs = term[order], owner[order], n[order], docs[order]
        lang = lang_of[owner]
        begins = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])]))
        ends = np.append(begins, len(term)).astype(np.int32)
        sources = pa.DictionaryArray.from_arrays(pa.array(owner, pa.int32()), pa.array([s for _, s in names], pa.string())).cast(pa.string())
        langs = pa.DictionaryArray.from_arrays(pa.array(lang[begins], pa.int32()), pa.array(list(numbers), pa.string())).cast(pa.string())
        terms = pa.array([self.spelled[h].decode() for h in term[begins].tolist()], pa.string())
        out = [langs, terms, pa.array(np.add.reduceat(docs, begins)), pa.ListArray.from_arrays(ends, sources), pa.ListArray.from_arrays(ends, pa.array(n))]
        self.__init__()
        return pa.RecordBatch.from_arrays(out, ["lang", "term", "docs", "sources", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = _Counter()
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("sources").to_pylist()
        data, offsets = w.text_buffers(batch.column("text"))
        for i, j in w.chunks(offsets):
            at = offsets[i: j + 1]
            found = w.words_of(data[at[0]: at[-1]], at - at[0], upper_to_lower=True, separator=NO_TERM)
            if len(found.starts):
                counter.add(langs[i:j], sources[i:j], found)
            if counter.full:
                yield counter.result()
    if counter.size:
        yield counter.result()


def collapsed(docs: DataFrame) -> DataFrame:
    """Distinct (lang, text) with sources, an array of (source, n).

    Copies meet as digests; their text is moved once for each task that holds one, and
    lands where the numbers of the digest are.
    """
    digest = F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")
    held = docs.groupBy("lang", digest, "source").agg(F.count("*").alias("n"))
    sources = held.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    texts = docs.groupBy("lang", digest).agg(F.first("text").alias("text"))
    return texts.join(sources, ["lang", "digest"]).select("lang", "text", "sources")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share, in whole numbers of any size; null where there are no terms."""
    above = F.lit(SCALE).cast("decimal(12,0)") * (count + ADDED).cast("decimal(19,0)")
    below = (total + ADDED * terms).cast("decimal(19,0)")
    return F.when(terms > 0, F.call_function("div", above, below) + 1)


def _compare(table: pa.Table, block_sources: int, matrix_terms: int) -> pa.Table:
    """Differences of the pairs of sources of a tile over the terms of a bucket.

    Rows without a term are the sources, with the share of a term that they lack.
    """
    number, share = table.column("number").to_numpy(), table.column("share").to_numpy()
    named = np.asarray(table.column("term").is_valid())
    lang, bucket, i, j, terms = (table.column(c)[0].as_py() for c in ("lang", "bucket", "i", "j", "terms"))
    at = np.flatnonzero(~named)
    sources, first = np.unique(number[at], return_index=True)
    lacking = share[at[first]]
    apart = np.abs(lacking[:, None] - lacking)
    alone, both = np.zeros_like(apart), np.zeros_like(apart)
    block = sources // block_sources
    entries = np.flatnonzero(named)
    term = table.column("term").take(pa.array(entries)).combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(term, kind="stable")
    term, source, p = term[order], np.searchsorted(sources, number[entries][order]), share[entries][order]
    for low in range(0, int(term.max(initial=-1)) + 1, matrix_terms):
        a, b = np.searchsorted(term, [low, low + matrix_terms])
        rows = int(term[b - 1]) - low + 1
        shares, has = np.repeat(lacking[None, :], rows, axis=0), np.zeros((rows, len(sources)), dtype=bool)
        shares[term[a:b] - low, source[a:b]], has[term[a:b] - low, source[a:b]] = p[a:b], True
        for s in np.unique(source[a:b]):
            other = slice(None) if i == j else block == (i if block[s] == j else j)
            own = has[:, s]
            more = np.abs(shares[own][:, other] - shares[own, s][:, None]) - apart[s, other]
            shared = has[own][:, other]
            both[s, other] += np.where(shared, more, 0).sum(axis=0)
            alone[s, other] += np.where(shared, 0, more).sum(axis=0)
    value = alone + alone.T + both
    if bucket == 0:
        value = value + (terms or 0) * apart
    x, y = np.nonzero((block[:, None] == i) & (block == j) & (sources[:, None] < sources) & ((value != 0) | (bucket == 0)))
    return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "a": pa.array(sources[x], pa.int32()), "b": pa.array(sources[y], pa.int32()), "value": pa.array(value[x, y], pa.int64())})


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 30, top: int = 50,
    block_sources: int = BLOCK_SOURCES, bucket_counts: int = BUCKET_COUNTS, matrix_terms: int = MATRIX_TERMS,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every language and source that occurs.

    A language keeps the terms in ``least_docs`` of its documents. A group's share of a term
    is 1 + floor(10**9 * (n + 5) / (N + 5 * V)), with n its occurrences in the group, N that of
    all kept terms and V their number; the same for the language as a whole. Part ``pair``:
    the summed absolute differences of shares to each other source of the language (0 without
    kept terms). Part ``term``: the ``top`` terms by which the source's share exceeds the
    language's most. Ranks start at 1, highest value first, ties by the item's UTF-8 bytes.

    Null text, lang and source count as empty, a source without terms takes part in pairs,
    repeated rows are documents of their own, other columns are not looked at, and an empty
    table gives no rows. Texts are taken for identical by their 128-bit digest. Arithmetic is
    in whole numbers.
    """
    whole = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = session.materialize(collapsed(whole).mapInArrow(_count, _COUNTED), "audit-counted")
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term")
    each = F.explode(F.arrays_zip("sources", "counts")).alias("held")
    entries = counted.join(kept, ["lang", "term"]).select("lang", "term", each)
    entries = entries.groupBy("lang", F.col("held.sources").alias("source"), "term").agg(F.sum("held.counts").alias("n"))
    entries = session.materialize(entries, "audit-entries")

    overall = entries.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = overall.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = whole.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.withColumns({
        "total": F.coalesce("total", F.lit(0)), "terms": F.coalesce("terms", F.lit(0)),
        "number": (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"),
    })
    groups = session.materialize(groups, "audit-groups")

    placed = entries.join(groups.select("lang", "source", "number", "total", "terms", "lang_total"), ["lang", "source"])
    placed = placed.withColumn("share", _share(F.col("n"), F.col("total"), F.col("terms")))
    placed = session.materialize(placed, "audit-shares")

    usual = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    above = placed.join(overall, ["lang", "term"]).select("lang", "source", F.col("term").alias("item"), (F.col("share") - usual).alias("value")).filter("value > 0")
    best = _ranked(above).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))

    # Tiles: a bucket of a language's terms, and two blocks of its sources.
    plan = groups.groupBy("lang").agg(
        F.greatest(F.ceil(F.sum("rows") / bucket_counts), F.lit(1)).cast("int").alias("buckets"), F.floor(F.max("number") / block_sources).cast("int").alias("last"),
    )
    block = F.floor(F.col("number") / block_sources).cast("int")
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j")))).alias("tile")
    none = F.coalesce(_share(F.lit(0).cast("long"), F.col("total"), F.col("terms")), F.lit(0))
    held = placed.join(plan, "lang").select("lang", "terms", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), tile, "number", "term", "share")
    lacking = groups.join(plan, "lang").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    lacking = lacking.select("lang", "terms", "bucket", tile, "number", F.lit(None).cast("string").alias("term"), none.alias("share"))
    tiles = held.unionByName(lacking).select("lang", "terms", "bucket", "tile.i", "tile.j", "number", "term", "share")
    pairs = tiles.groupBy("lang", "bucket", "i", "j").applyInArrow(lambda table: _compare(table, block_sources, matrix_terms), "lang string, a int, b int, value long")
    pairs = session.materialize(pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "audit-pairs")
    names = groups.select("lang", "number", "source")
    ways = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("number"), F.col("b").alias("other")), F.struct(F.col("b").alias("number"), F.col("a").alias("other")))).alias("way"))
    ways = ways.select("lang", "value", "way.number", "way.other").join(names, ["lang", "number"]).drop("number")
    ways = ways.join(names.select("lang", F.col("number").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    every = _ranked(ways.select("lang", "source", "item", "value")).withColumn("part", F.lit("pair"))
    return every.unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

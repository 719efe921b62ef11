"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollbook import session
from rollbook.llm import centroids, classifier, divergence, jaccard, line_dedup, mixing, packing, prefix, rules, sharding, substrings, token_files, topk, url_lists

#: Folder of the public tokenizers' files; None: where their package lies.
TOKENIZERS: str | None = None

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    if TOKENIZERS is not None:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document; sources weigh 1, 2, 3 in turn."""
    docs = table(spark, folder, "documents").select("doc_id", "source", prefix.word_count(F.col("text")).alias("size"))
    # Sorting by ranges reads its input twice; the texts are read once.
    mixed = mixing.mix(session.materialize(docs, "mix-sizes"), F.col("source"), F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


@query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    packed = packing.pack_documents(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), 1, 4096)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op3_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learnt from four fifths of the labels."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    weights = classifier.fit(docs, labels.filter(~held_out).select("doc_id", F.col("quality").cast("int").alias("label")))
    scored = classifier.score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 contiguous shards of nearly equal bytes."""
    docs = table(spark, folder, "documents").select(
        "doc_id", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("bytes"),
    )
    # Sorting by ranges reads its input twice; the texts are read once.
    cut = sharding.shard(session.materialize(docs, "shard-sizes"), F.col("bytes"), [F.col("doc_id"), F.col("text_crc32"), F.col("bytes")], 24)
    return cut.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Every page against two dated lists that the pages themselves give.

    A page counts as fetched on a day of 2024 that follows from its id. A host is listed as
    insecure from the day after it was seen over http until the day after it was seen only
    over https; a folder as tracking in the same way, by campaign parameters.
    """
    pages = table(spark, folder, "pages").select("page_id", "url", F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int").alias("fetch_day"))
    url, after = F.col("url"), F.col("fetch_day") + 1
    insecure = pages.select(F.lit("insecure").alias("list"), url_lists.host(url).alias("key"), after.alias("day"), url.startswith("http://").alias("listed"))
    tracking = pages.select(F.lit("tracking").alias("list"), url_lists.folder(url).alias("key"), after.alias("day"), url.contains("utm_source=").alias("listed"))
    tested = url_lists.active(pages, url, F.col("fetch_day"), insecure.unionByName(tracking).filter("key <> ''"))
    return tested.select("page_id", "fetch_day", "n_active", "lists", "blocked")


ORACLES["op5_url_lists"] = """
WITH page AS (
    SELECT row_number() OVER () AS nr, page_id, url, CAST((page_id * 7919) % 366 AS INTEGER) AS fetch_day,
        lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
        regexp_extract(url, '^[^:/?#]+://[^/?#]+/([^/?#]+)', 1) AS segment
    FROM pages
), entry AS (
    SELECT 'insecure' AS list, host AS key, fetch_day + 1 AS day, starts_with(url, 'http://') AS listed FROM page WHERE host <> ''
    UNION ALL
    SELECT 'tracking', host || '/' || segment, fetch_day + 1, contains(url, 'utm_source=') FROM page WHERE host <> '' AND segment <> ''
), daily AS (
    SELECT list, key, day, bool_or(listed) AS listed FROM entry WHERE day IS NOT NULL GROUP BY ALL
), held AS (
    SELECT list, key, day AS begins, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS ends, listed FROM daily
), label AS (
    SELECT nr, fetch_day, host, segment, string_split(host, '.') AS labels FROM page WHERE host <> ''
), asked AS (
    SELECT DISTINCT nr, fetch_day, key FROM (
        SELECT nr, fetch_day, unnest(list_transform(range(1, len(labels) + 1), lambda k: array_to_string(labels[k:], '.'))) AS key FROM label
        UNION ALL
        SELECT nr, fetch_day, host || '/' || segment FROM label WHERE segment <> ''
    )
), met AS (
    SELECT nr, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
    FROM asked JOIN held ON asked.key = held.key AND listed AND begins <= fetch_day AND (ends IS NULL OR fetch_day < ends) GROUP BY nr
)
SELECT page_id, fetch_day, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, n_active IS NOT NULL AS blocked
FROM page LEFT JOIN met USING (nr)
"""


@query
def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    rows = table(spark, folder, "embeddings").filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    return topk.top_k(whole, F.col("vec_id") % 50 == 0, 5)


@query
def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every text when repeated windows of 35 words go."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, "text", 35).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as token ids in 16 bits each, and read back."""
    path = session.new_shared_path(spark, "token-files")
    token_files.write(table(spark, folder, "documents"), path, tokenizer("byte_bpe_50k.json"), 2, 50_257)
    return token_files.documents(token_files.read(spark, path))


@query
def op9_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Near copies among all documents: five-word shingles, similarity of 0.75 or more."""
    return jaccard.near_copies(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op10_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    judged = rules.judge(table(spark, folder, "documents"), labels)
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept", "anomaly")


@query
def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Eight clusters of all vectors of 64 whole components, after ten rounds."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, folder, "embeddings").filter((F.size("embedding") == 64) & finite)
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("vector"))
    return centroids.cluster(whole).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


ORACLES["op11_centroids"] = """
WITH RECURSIVE vector AS MATERIALIZED (
    SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), seed AS (
    SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS c, v FROM vector QUALIFY c < 8
), step(r, c, v) AS (
    SELECT 0, c, v FROM seed
    UNION ALL
    SELECT s.r + 1, s.c, coalesce(m.v, s.v) FROM step s LEFT JOIN (
        SELECT c, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
            SELECT c, i, sum(x) AS total, count(*) AS n FROM (
                SELECT b.best.c AS c, unnest(vector.v) AS x, unnest(range(64)) AS i FROM (
                    SELECT nr, min(struct_pack(d := CAST(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - t.v[i]) * (x.v[i] - t.v[i]))) AS BIGINT), c := t.c)) AS best
                    FROM vector x, step t GROUP BY nr
                ) b JOIN vector USING (nr)
            ) GROUP BY c, i
        ) GROUP BY c
    ) m ON m.c = s.c WHERE s.r < 10
), final AS (
    SELECT c, v, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM step WHERE r = 10
), assigned AS (
    SELECT nr, x.vec_id, min(struct_pack(d := CAST(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - t.v[i]) * (x.v[i] - t.v[i]))) AS BIGINT), c := t.c)) AS best
    FROM vector x, final t GROUP BY nr, x.vec_id
)
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM assigned JOIN final ON final.c = best.c
"""

@query
def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How the sources of every language differ, pair by pair and in their own terms."""
    return divergence.audit(table(spark, folder, "documents"))


ORACLES["op12_divergence"] = r"""
WITH doc AS (
    SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), word AS (
    SELECT nr, lang, source, unnest(terms) AS term FROM doc
), kept AS (
    SELECT lang, term, count(*) AS n FROM word GROUP BY ALL HAVING count(DISTINCT nr) >= 30
), held AS (
    SELECT lang, source, term, count(*) AS n FROM word SEMI JOIN kept USING (lang, term) GROUP BY ALL
), whole AS (
    SELECT lang, sum(n) AS total, count(*) AS terms FROM kept GROUP BY lang
), grp AS (
    SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN held USING (lang, source) GROUP BY ALL
), share AS (
    SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 5)) // (g.total + 5 * v.terms) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.terms) AS q
    FROM grp g JOIN whole v USING (lang) JOIN kept k USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
), every AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
        SELECT x.lang, x.source AS one, y.source AS two, sum(abs(x.p - y.p)) AS value
        FROM share x JOIN share y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
    ) d ON d.lang = a.lang AND d.one = a.source AND d.two = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM share WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query
def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every text when lines of 40 characters in five documents go."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLES["op13_line_dedup"] = r"""
WITH line AS (
    SELECT nr, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place
    FROM (SELECT row_number() OVER () AS nr, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), common AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT nr) >= 5
), judged AS (
    SELECT k.*, c.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY nr, doc_id
"""

ORACLES["op6_topk"] = """
WITH vector AS (
    SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS whole FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.nr, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.whole, b.whole) AS BIGINT) AS score
    FROM vector a JOIN vector b ON a.nr <> b.nr AND len(a.whole) = len(b.whole) WHERE a.vec_id % 50 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op7_substrings"] = r"""
WITH spelled AS (
    SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), begun AS (
    SELECT nr, words, unnest(range(1, len(words) - 33)) AS s FROM spelled WHERE len(words) >= 35
), windows AS (
    SELECT nr, s, md5(array_to_string(words[s:s + 34], ' ')) AS h FROM begun
), twice AS (
    SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
    SELECT DISTINCT nr, unnest(range(s, s + 35)) AS p FROM windows JOIN twice USING (h)
), placed AS (
    SELECT nr, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM spelled
), kept AS (
    SELECT nr, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM placed ANTI JOIN gone USING (nr, p) GROUP BY nr
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept.text, '')) AS kept_sha256
FROM spelled LEFT JOIN kept USING (nr)
"""

ORACLES["op9_jaccard"] = r"""
WITH RECURSIVE spelled AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, h FROM (
        SELECT doc_id, md5(array_to_string(words[s:s + 4], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS s FROM spelled WHERE len(words) >= 5)
        UNION ALL
        SELECT doc_id, md5(array_to_string(words, ' ')) FROM spelled WHERE len(words) BETWEEN 1 AND 4
    )
), held AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
    SELECT c.a, c.b FROM common c JOIN held x ON x.doc_id = c.a JOIN held y ON y.doc_id = c.b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)
), reached(doc_id, least) AS (
    SELECT b, a FROM link UNION SELECT a, b FROM link
    UNION
    SELECT r.doc_id, l.o FROM reached r JOIN (SELECT a AS i, b AS o FROM link UNION ALL SELECT b, a FROM link) l ON l.i = r.least
)
SELECT s.doc_id, coalesce(any_value(held.n), 0) AS n_shingles, least(s.doc_id, min(r.least)) AS component_id
FROM spelled s LEFT JOIN held USING (doc_id) LEFT JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""

ORACLES["op4_sharding"] = """
WITH RECURSIVE step(i, k, c) AS (
    SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY i) AS of_byte FROM step WHERE k = 8
), bytes AS (
    SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x:
        CAST(16 * (strpos('0123456789ABCDEF', x[1]) - 1) + strpos('0123456789ABCDEF', x[2]) - 1 AS BIGINT)) AS b FROM documents
), sized AS (
    SELECT doc_id, CAST(coalesce(len(b), 0) + 8 AS BIGINT) AS size,
        CAST(xor(list_reduce(b, lambda c, x: xor(c >> 8, of_byte[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32
    FROM bytes, crc
), summed AS (
    SELECT *, CAST(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before,
        CAST(sum(size) OVER () AS BIGINT) AS total
    FROM sized
), cut AS (
    SELECT *, CAST(least((2 * before + size) * 24 // (2 * total), 23) AS INTEGER) AS shard FROM summed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

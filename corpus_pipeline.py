"""A training corpus from raw documents, stage by stage.

Stages take and return the columns of ``documents``; the last returns the packed pieces.
Each handles null and empty texts (no words: kept, linked with nothing, one token), repeated
rows (of near copies one stays; elsewhere they are separate documents) and empty tables (no
rows); columns beyond those of ``documents`` are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollbook import session
from rollbook.llm import classifier, jaccard, mixing, packing, prefix, substrings
from rollbook.llm.queries import table, tokenizer

#: Columns that all stages but the last return.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of a lower quality score go.
LEAST_SCORE = 0.3
#: Words of a window that may occur once in the corpus.
WINDOW = 35
#: Sources' weights in turn, times that a document may be taken, and ids of a sequence.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
CAPACITY = 4096


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least 0.3; the classifier learns from ``labels``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    weights = classifier.fit(docs, labels)
    return classifier.score(docs.select(*DOCUMENT), weights).filter(F.col("score") >= LEAST_SCORE).select(*DOCUMENT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies, that of the smallest id."""
    return jaccard.one_of_each(docs.select(*DOCUMENT))


def drop_repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 35 words that also start elsewhere; other texts unchanged.

    A document that loses all its words stays, with an empty text.
    """
    left = substrings.remove_repeats(docs.select(*DOCUMENT), "text", WINDOW).withColumnRenamed("kept", "text")
    changed = F.col("n_removed") > 0
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    mixed = mixing.mix(docs.select(*DOCUMENT), F.col("source"), prefix.word_count(F.col("text")), WEIGHTS, MOST_COPIES)
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*DOCUMENT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), 1, CAPACITY)


STAGES = [
    ("quality", keep_quality), ("near_copies", drop_near_copies), ("repeated_text", drop_repeated_text),
    ("mix", mix_sources), ("pack", pack_sequences),
]

#: Learnt scores, solved rates and a genetic search cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``; each result is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = session.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents, extra ones included, whatever
their names.  An empty table passes through every stage as an empty table; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concordia.llm import langid, minhash, mixing, packing, secrets
from concordia.llm._common import stage
from concordia.llm.queries import tokenizer_path

#: Between what was measured on held-out texts: at sf0.1 learned languages score 0.66 at least (99.9% of the texts 0.85),
#: sentences in eight languages that were not learned 0.31 at most, and random letters 0.09.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those that share too few n-grams with any learned language.

    Null, empty and blank texts and texts without a letter go; a null id or source changes nothing, and a null
    language only means that the row is not learned from.  Repeated rows share one fate.  Without any labelled
    row nothing is known, and every document goes.
    """
    filters = langid.fit_filters(docs.where(langid.ticket("doc_id") % 4 != 2))
    return langid.in_learned_language(docs, filters, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of the smallest id, a null id last, ties by a hash of the text.

    Null, empty and blank texts have no shingles and all stay; of rows that repeat in id and text one stays.
    """
    return minhash.deduplicate(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts and sets ``n_chars`` of the changed ones; every row stays, null texts as they are."""
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: repeated epochs are repeated rows, and the last document of a source is shortened.

    A null source is a source of its own, last in order; null and blank texts have no words and are not in the mix;
    repeated rows count each; rows of equal id and text are interchangeable, so reruns agree.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset: a null or empty text is its end token alone, repeated rows pack each."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mix),
    ("packing", pack),
]

#: Bloom filters, MinHash buckets and BPE are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents of *sf_dir*."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

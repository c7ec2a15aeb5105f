"""A corpus from documents to packed sequences, in stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works
on all that its predecessor kept and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from captext.llm.language import known_language
from captext.llm.mixing import mixed_documents
from captext.llm.packing import pack
from captext.llm.simhash import first_of_groups
from captext.llm.substrings import without_repeats
from captext.session import discard, scratch, small_batches


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go."""
    small_batches(spark)
    return known_language(docs, public_tokenizers.path("piece_bpe_32k.model"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    small_batches(spark)
    return first_of_groups(docs, shingle=NEAR_SHINGLE, least=NEAR_SIMILARITY)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier in the corpus too are cut out of the texts."""
    small_batches(spark)
    return without_repeats(docs, least=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight has it."""
    small_batches(spark)
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences of at most 2048 ids."""
    small_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


#: Words of a shingle of the near-copy stage, and the Jaccard similarity from which texts are near copies.
NEAR_SHINGLE = 5
NEAR_SIMILARITY = 0.8

STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Tokenising, fingerprints and learned models are not for SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs

"""The corpus pipeline: each stage calls one operator of ``lodestone.llm`` on all that its predecessor kept.

All stages but the last return the columns of their input, whatever these are called.  Null doc_ids, texts, languages and
sources are values like others; an empty table stays empty; rows that are repeated are judged alike.  Each stage says below
what that means for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, langid, minhash, mixing, tokens
from lodestone.llm.common import BATCH_ROWS
from lodestone.storage import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown go: no text, no letter in it, or a score below ``langid.LEAST_SCORE``.

    A null lang teaches nothing; without any label all go.  Repeated rows stay or go together.
    """
    return langid.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each near-duplicate group stays: five-word shingles, similarity 0.8.

    Rows without doc_id, text or word are linked with nothing and stay; rows that share a doc_id are one document, and all of
    them stay or go.
    """
    return minhash.keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null texts and items contain nothing and stay; rows that are equal in doc_id and text go together.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at weights 5, 2, 1: a row per document and pass, with the words which that pass takes.

    The null source comes last; documents without words take nothing and go; repeated rows are documents of their own; ties
    in the order are settled by hashes of all columns.
    """
    # the rows are made while the caller writes them: whole texts then travel to Python and back in small batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, most_repeats=2)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in PFOR shards, as read back: doc_id, start, n_tokens, ids_crc32.

    A null text is one end id; rows without doc_id come first; rows that share a doc_id follow each other in the order of
    their texts.
    """
    return tokens.token_table(docs, tokens.default_tokenizer(), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]
#: The stages learn, hash and tokenise, which SQL cannot express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on the documents table; each stage's rows are written in the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: language, near duplicates, benchmark, personal data, packing.

Every stage works on all that its predecessor kept.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontam, langid, ngram_join, packing, pii
from tickloom.llm.shared import discard, stored, table


#: Texts that a Python worker gets at a time; Spark's default of 10,000 can be a hundred megabytes of long ones.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bound what a worker holds of one batch.  The setting stays: Spark reads it when a stage's result is written."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter or without a clear language go."""
    small_batches(spark)
    return langid.accept(docs, langid.fit(docs))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a five-word shingle similarity of 0.8 or more, the smallest doc_id stays."""
    small_batches(spark)
    return ngram_join.one_per_component(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark windows go."""
    small_batches(spark)
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    small_batches(spark)
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack),
]

#: Trained models and a tokenizer decide what stays, which SQL can't express; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it; what a stage has read is deleted then.

    The session gets its batch size back.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(name), table(spark, sf_dir, "documents")
    try:
        for step, stage in STAGES:
            found = stored(stage(spark, docs, sf_dir), step)
            discard(docs)
            docs = found
    finally:
        spark.conf.set(name, before)
    return docs

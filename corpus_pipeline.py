"""The corpus pipeline: five stages over ``documents``, each one operator.

1. language identification; documents that it rejects go
2. n-gram Jaccard join; the lowest id of each group of near-duplicates stays
3. benchmark decontamination; documents that hold a benchmark window go
4. PII; spans are replaced by their kind
5. best-fit packing; the result is the pieces with their sequences

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each result as Parquet
in the shared folder and reads it for the next stage. Rows with a null id pass
the first two stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontamination, language_id, ngram_jaccard, packing, pii
from vellum.llm.common import materialize, small_batches, small_or_shuffled, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language_id.keep_identified(docs, host="source").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    joined = ngram_jaccard.ngram_jaccard_join(docs)
    gone = materialize(joined.where("component_id != doc_id").select(F.col("doc_id").alias("__gone")))
    return docs.join(small_or_shuffled(gone, gone.count()), docs.doc_id == F.col("__gone"), "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", personal_data),
    ("best_fit_packing", pack),
]

#: Tokenizers and models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from ``documents`` to packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

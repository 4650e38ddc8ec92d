"""The corpus pipeline: five stages over ``documents``, each on all that the one before it kept.

``run`` writes every stage's rows as Parquet in the shared folder and reads them
again, so a lost executor costs a stage's tasks and never an earlier stage.

1. language: drops the documents whose language is rejected (no letter, or a
   score below the model's calibrated limit).
2. near_duplicates: keeps the smallest doc_id of each group of documents whose
   five-word shingle sets have a Jaccard similarity of 0.8 or more.
3. decontamination: drops the documents that hold a benchmark item (0.8 or more
   of its words in place).
4. personal_data: replaces personal data by its kind in brackets.
5. tokens: BPE ids of the text left: doc_id, n_tokens, ids_sha256,
   decoded_sha256.

Results for unusual input: a document without a letter (null and empty texts
too) is rejected by the first stage; rows that repeat an id are judged by their
own texts, each for itself, and of equal rows one stays; the smallest id of a
group stays, and rows without an id are held against rows of equal shingles
only; a text of any length is judged whole; an empty table, or one without labelled documents to learn
languages from, gives an empty result; extra columns go through all stages but
the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import bpe_digests
from tidemark.llm.common import bounded_batches, forget, scratch_path, table
from tidemark.llm.decontam import decontaminate
from tidemark.llm.jaccard import keep_first
from tidemark.llm.langid import keep_identified
from tidemark.llm.pii import redact
from tidemark.llm.queries import tokenizer_path

#: SQL can't express a trained model or BPE.
ORACLE_SQL = None

SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return keep_first(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return bpe_digests(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data directory."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # a stage's rows are read by the next one only
            forget(spark, before)
        before = path
    return docs

"""From raw documents to training records, stage by stage.

Every stage works on all that the stage before it kept, and its result is written as Parquet and
read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.decontaminate import decontaminate
from sievecraft.llm.language_id import fit, held_out, predict
from sievecraft.llm.minhash_dedup import drop_near_duplicates
from sievecraft.llm.mixing import mixed_documents
from sievecraft.llm.scratch import prepare, settled
from sievecraft.llm.token_records import read_records, write_records

#: Id that ends each document.
END_ID = 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the predicted language; documents without a letter or far from all languages go.

    Languages are learned from the labelled documents that are not held out; without any, all documents go.
    Null and empty texts have no letter. Repeated rows are judged alike, and all other columns stay.
    """
    prepare(spark)
    judged = predict(docs, fit(docs.where(~held_out())))
    named = judged.where("NOT rejected").withColumn("lang", F.col("lang_pred"))
    return named.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Rows that repeat that doc_id with an equal text are one document and stay together. Rows without a doc_id go if their group has one.
    """
    prepare(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of ``benchmark`` go. Null texts, and all documents if it has no words, stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to weights 5, 2, 1: a document appears once for each pass in which blocks of it were drawn."""
    return mixed_documents(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as binary records; what reading them back gives: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    prepare(spark)
    shards = write_records(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, special=True)
    return read_records(shards, with_ids=False)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_records", token_records),
]

#: SQL expresses neither the classifier nor the tokenizer; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

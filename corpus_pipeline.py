"""The corpus pipeline: toxicity, near-duplicates, decontamination, secrets, encoding.

Each stage calls one operator of parley.llm on all that its predecessor kept; `run` writes every
stage's result as Parquet in the shared folder and reads it back for the next. The first four
return documents' columns: rejected documents are gone, of each group of near copies the one with
the smallest doc_id is left. The last returns the ids of the documents kept. Missing texts pass the
filters (as empty ones, near copies of one another); an empty table gives an empty result.

SQL cannot express the trained model, the components or the encoder, so ORACLE_SQL is None; the
tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontaminate, secrets_scan, sentencepieces, simhash, toxicity
from parley.llm.common import table, written
from parley.llm.queries import PIECE_MODEL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_scan.without_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = sentencepieces.encode(docs, PIECE_MODEL)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", drop_secrets),
    ("encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

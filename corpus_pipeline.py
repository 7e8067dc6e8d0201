"""A training-corpus pipeline of five stages over ``documents``; each stage's output is written as Parquet and read again.

Every stage but the last returns the columns of its input, whatever their names. Null, empty and blank texts
pass all of them and come out of packing with one row and no bin; very long texts are taken whole; rows without
an id pass (they are no one's copy); of rows that repeat an id one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import decontaminate, minhash, packing, secrets, toxicity
from postlens.llm.shared import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. Labels are learnt from outside the held-out fold; without any nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(toxicity.held_out() != 0)
    names = docs.columns
    scored = toxicity.score(docs, toxicity.train(docs, labels), name="_toxicity_of_text")
    return scored.where(F.col("_toxicity_of_text") < 0.5).select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id; texts without words have no copies."""
    return minhash.keep_one(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out and ``n_chars`` follows; documents that are mostly such passages go."""
    return decontaminate.cut_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark and ``n_chars`` follows; texts without any stay as they are."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the training sequences, a row for each piece of it."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: A learnt score decides the first stage, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

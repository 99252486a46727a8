"""Corpus pipeline: documents through the stages in order, each written as Parquet and reread by the next.

Toxicity drops the documents that the classifier rejects, exact dedup keeps the largest doc_id of equal texts, near-dedup
the smallest doc_id of each component of near copies, the secret scan replaces secrets by a mark, packing makes the
training sequences. The first four return the columns of documents. Stages that end in a Python step return its staged output:
their caller's write would send Python batches of 10,000 whole texts, which both sides hold in memory."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import exact_dedup, near_dedup, pack_docs, secrets, toxicity
from stratalog.llm.common import fresh, release, scope, shared_dir, stage, table

#: Near copies share four fifths of their five-word shingles at least.
PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = fresh(docs, "_toxicity")
    return stage(toxicity.score(docs, model, out=out).where(F.col(out) < toxicity.CUT).select(*docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs, percent=PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs)
    return stage(out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in out.columns else out)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage(pack_docs.pack(docs, public_tokenizers.path(pack_docs.VOCABULARY)))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can't express a trained classifier or a tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's intermediate tables go when its output is written; the outputs stay."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/stratalog-pipeline-{uuid.uuid4().hex}"
    for i, (_, step) in enumerate(STAGES):
        with scope() as made:
            out = step(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{i}")
        release(spark, made)
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}")
    return docs

"""From raw documents to tokens: quality, exact copies, near copies, benchmark passages, tokens.

Each stage gets all that the one before it kept, as a table that was written and read again.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from modalith.llm.bpe import encode_documents
from modalith.llm.common import shared_folder, table
from modalith.llm.decontaminate import drop_leaks
from modalith.llm.exact_dedup import drop_exact_copies
from modalith.llm.near_dedup import drop_near_copies
from modalith.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs.select("doc_id", "text"), text=False)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontamination), ("bpe", tokens)]

#: SQL can't train the classifier, nor merge byte pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage's table lies in the folder of spark.checkpoint.dir."""
    place = os.path.join(shared_folder(spark), f"corpus-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}_{name}")
        docs = spark.read.parquet(f"{place}/{i}_{name}")
    return docs

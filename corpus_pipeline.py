"""The corpus pipeline: from documents to token ids, each stage over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of ``docs``, extra ones included.

Defined results: null texts have no words and go with the quality rules; repeated rows are judged alike and
only one of them passes the near-duplicate stage; an empty table stays empty through all stages; extra
columns may have any names, also those that the operators use.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm import bpe, decontaminate, lines, minhash, quality
from aerolake.llm.queries import vocabulary
from aerolake.llm.tables import shielded
from aerolake.session import shared_folder, ship_code


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host fails, go."""
    ship_code(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; a document of which no word is left goes."""
    ship_code(spark)

    def cleaned(rows: DataFrame) -> DataFrame:
        return lines.drop_repeats(rows).filter((F.col("x_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))

    return shielded(docs, ("doc_id", "text"), cleaned)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    ship_code(spark)
    return minhash.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    ship_code(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return shielded(docs, ("text",), lambda rows: decontaminate.scan_documents(rows, benchmark).filter("d_n_hit = 0"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, input_ids)."""
    ship_code(spark)
    return bpe.encode(docs.select("doc_id", "text"), vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Near-duplicate components and tokenizer ids have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the result is the last stage's table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""A training corpus from `documents`, in five stages; each writes its rows and the next reads them.

All stages but the last return the columns that they were given; the last adds copy and order_key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulequarry.llm import decontaminate, jaccard_join, mixing, quality_rules, secret_scan
from rulequarry.llm._scratch import drop, scratch, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and have enough content lines."""
    model = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.kept_rows(docs, model).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the least doc_id, and of its rows one."""
    return jaccard_join.representatives(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't cover half of a benchmark item or more."""
    found = decontaminate.coverage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~decontaminate.contaminated()).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew."""
    return secret_scan.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents repeated so that sources weigh alike, in a global random order."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
]

#: Conditional random fields, tiling and randomness tests have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch() as kept:  # what a stage has written for itself goes with its end
            before, docs = docs, written(stage(spark, docs, sf_dir), f"stage{k + 1}")
            kept.append(docs)
        drop(before)  # the table of the stage before; the documents themselves are none
    return docs

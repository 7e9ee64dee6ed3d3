"""Corpus pipeline: five stages from raw documents to a mix of sources.

Each stage takes the documents that the one before kept and returns those it keeps, with the same columns; the
last returns the mix, one row for each document in it: how often its text is repeated as a whole and how many of its
first words follow once more.

Defined cases, beside those of each operator: other columns of the documents go through unchanged whatever their
names; documents without text are rejected by the quality stage, those without a
letter by the language stage, also when no language can be learned; of repeated rows with one id and text the
near-duplicate stage keeps one; documents without id are never near duplicates; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaidframe.llm import decontaminate, language, mixing, neardup, quality
from plaidframe.llm.common import read
from plaidframe.session import scratch_path

ORACLE_SQL = None  # classifiers, hashing and the order of draws are no SQL; the tests compare stage by stage


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator needs beside the row as a whole, so that no name can clash."""
    return docs.select(F.struct("*").alias("__row"), *columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classifier, _ = quality.train(docs, read(spark, sf_dir, "labels"))
    return classifier.apply(packed(docs, "doc_id", "text")).where("kept").select("__row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = language.train(docs)
    if not filters.langs:  # nothing learned, nothing to tell by
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = language.identify(packed(docs, "text", "lang"), filters)
    return told.where(~language.rejected(language.least_score(told))).select("__row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = (neardup.near_duplicates(docs, percent=80).where(~F.col("kept"))
            .select(F.col("doc_id").alias("__gone")).distinct())
    left = packed(docs, "doc_id", "text").join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    return (left.withColumn("__copy", F.row_number().over(same))
            .where(F.col("doc_id").isNull() | (F.col("__copy") == 1)).select("__row.*"))


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(packed(docs, "text"), read(spark, sf_dir, "benchmark"))
    return marked.withColumn("n_hit", decontaminate.n_hit()).where(~decontaminate.contaminated()).select("__row.*")


def mix_of_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).where(F.col("taken") > 0)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", free_of_benchmark),
    ("mixing", mix_of_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``; every stage is written below the checkpoint folder and read again."""
    base = scratch_path(spark, f"corpus-{uuid.uuid4().hex}")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

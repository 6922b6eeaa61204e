"""A training corpus from documents: STAGES in order, each written as Parquet and read again.

quality rules     rows that the rules or the forest reject go
n-gram join       one document of each linked group stays, that of the least id
substring dedup   words under 13-word windows that a smaller id holds are cut
decontamination   documents that hold a benchmark item go
packing           the rest is packed into sequences of 2048 ids; one row for each piece
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palaver.llm.cluster import materialise, release
from palaver.llm.decontamination import keep_clean
from palaver.llm.ngram_join import keep_one
from palaver.llm.packing import pack
from palaver.llm.quality_rules import keep_good
from palaver.llm.substring_dedup import cut_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)[0]


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeats),
    ("benchmark_decontamination", leaks),
    ("best_fit_packing", packing),
]

#: The forest, the joins' components and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Each stage's table is deleted when the next is written; the last stage keeps what it needs itself."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
        if last is not None:
            release(last)
        last = docs
    return docs

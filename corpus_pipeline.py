"""Corpus pipeline over ``documents``: five stages, each on all that the stage
before it kept, written as Parquet in the shared folder and read again.

1. language ID: documents without a language leave;
2. n-gram Jaccard join: of each group of near copies one document stays;
3. benchmark decontamination: documents that hold a benchmark item leave;
4. mixing: all documents, sorted into the order of the target weights;
5. sharding: each document gets its slot and shard.

Every stage takes (spark, docs, sf_dir). All but the last return the columns
of ``documents``, also further ones that the table has. Null and empty texts
and texts without a letter leave in the first stage. Rows with a null id stay
rows of their own in stages 1 and 3 to 5; in stage 2 rows of equal sets are one
group whatever their ids, and of repeated rows one stays. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatlens.llm import decontaminate, language_id, mixing, ngram_join, sharding
from chatlens.llm.common import keep_table, prepare, table


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_id.with_language(docs)


def stage_ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.first_of_each(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"), short_span=1)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.in_mixed_order(docs)


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return sharding.place(docs)


STAGES = [
    ("language_id", stage_language_id),
    ("ngram_jaccard_join", stage_ngram_jaccard),
    ("benchmark_decontamination", stage_decontamination),
    ("source_mixing", stage_mixing),
    ("sharding", stage_sharding),
]

# the first stage predicts with learned machines, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

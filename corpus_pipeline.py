"""The corpus pipeline: quality rules, language ID, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and reread as the next one's docs.  All but the last return the columns of documents.

1. quality rules: rows that fail the base rules or the trees' verdict go.
2. language ID: rows without letters or without a clear language go; a null lang is filled in.
3. n-gram Jaccard join: of each group of near duplicates (five-word shingles, similarity of
   0.75 or more) the row of the least doc_id stays.
4. mixing: light sources are repeated, at most MAX_REPETITION times, towards equal weights,
   and rows are ordered by blocks of the mix; no row is dropped.
5. best-fit packing: rows of pieces with their sequences.

Empty tables pass through every stage.  Nulls are handled as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import langid, mixing, ngram_join, packing, quality_rules
from siltstone.llm._common import materialise, table

MAX_REPETITION = 1.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = quality_rules.fit_quality_trees(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, trees, passthrough=True)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit_langid(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, max_repetition=MAX_REPETITION)
    return mixed.repartitionByRange("block", "place").sortWithinPartitions("block", "place").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: The trained models and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

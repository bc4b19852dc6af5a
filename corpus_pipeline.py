"""The corpus pipeline: quality rules, toxicity, line dedup, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``. Classifiers are fitted on a bounded
sample of the labelled rows of the corpus itself; everything else covers all rows that reached the stage.

Defined results, for every stage: null and empty texts are documents without words (the quality rules reject them);
a null ``doc_id`` has no label and otherwise counts as any other; rows that repeat an id are judged one by one; of rows
that are equal in id and text the Jaccard stage leaves one; of linked documents the least id stays, ties by a hash of
the text; texts of any length are read whole; extra columns go through all stages but the last, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from traceloom.llm import jaccard_join, line_dedup, packing, quality_rules, toxicity
from traceloom.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned rules keep."""
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is that of no toxicity."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that nearly repeat an earlier line of the corpus."""
    return line_dedup.drop_repeated_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.keep_first(docs, k=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [("quality_rules", quality), ("toxicity", not_toxic), ("line_dedup", distinct_lines), ("ngram_jaccard_join", distinct_documents), ("best_fit_packing", packed)]

#: The learned stages cannot be expressed in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

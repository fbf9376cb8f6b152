"""Corpus preparation in five stages, each one of the training-data operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. Between stages the documents are
written as Parquet and read again, so a stage never depends on the lineage of the one before.
A row is decided by itself in every stage, also where rows share a doc_id or have none; extra columns pass
through, and an empty table stays empty. Line dedup stands before the near-copy join, so that the
join sees documents whose repeated lines are gone: near copies have by then lost what they shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scribelake.llm import decontam, langid, linededup, mixing, ngramjoin
from scribelake.llm.common import bound_batches, delete, materialize, new_path, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    bound_batches(spark)
    return langid.keep_identified(docs, langid.train(docs, fold=None))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay in the first document that holds them; documents left without a word go."""
    bound_batches(spark)
    return linededup.apply_bitmaps(docs, materialize(linededup.keep_bitmaps(docs)))  # written, so that packing and applying don't hold workers at once


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked class stays."""
    bound_batches(spark)
    return ngramjoin.keep_one(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bound_batches(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_test_items),
    ("mixing to target weights", mix_sources),
]

#: Language ID, near-copy components and the BM25 search have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the documents that the stages before it keep.

    What a stage writes for itself, and the stage before it, are deleted once its result is written.
    An empty table gives no rows.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            after, path = stage(spark, docs, sf_dir), new_path(spark, outside=True)
            after.write.parquet(path)
        docs = spark.read.schema(after.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

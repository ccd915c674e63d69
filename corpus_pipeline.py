"""The corpus pipeline: language ID, toxicity, line dedup, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import language_id, line_dedup, ngram_join, packing, toxicity
from tessera.llm.common import discard, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without letters, or of no clear language, go."""
    return language_id.stage(spark, docs, sf_dir)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    return toxicity.stage(spark, docs, sf_dir)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their hosts' boilerplate lines."""
    return line_dedup.drop_boilerplate(docs, counts=False)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in the training sequences."""
    return packing.query(docs)


STAGES = [("language_id", languages), ("toxicity", clean), ("line_dedup", lines), ("ngram_join", single), ("packing", packed)]

#: Models, components and bins have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        docs = written(out, name)
        discard(before, out)  # read no more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

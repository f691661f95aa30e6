"""A corpus pipeline from five operators of statuta.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's docs.  Executors give back the heap that the
stage before has left free.  All but the last return the columns of
documents, with the rows that they keep; the last returns one row per document
of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statuta.llm.decontaminate import drop_contaminated
from statuta.llm.language_id import keep_known_language
from statuta.llm.mixing import sample_documents
from statuta.llm.ngram_join import keep_one_of_each
from statuta.llm.store import materialise, shrink, table
from statuta.llm.token_files import token_output


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network recognises."""
    shrink(spark)
    return keep_known_language(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    shrink(spark)
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    shrink(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights."""
    shrink(spark)
    return sample_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the token files, in the order of their ids."""
    shrink(spark)
    return token_output(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_files", token_files),
]

#: A trained network and a similarity join are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

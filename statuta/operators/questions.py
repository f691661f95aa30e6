"""Queries for retrieval: lines that look like questions, or fixed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.operators.triples import first_of_each

LEAST_WORDS, MOST_WORDS, MOST_QUESTIONS = 3, 40, 50
#: The queries used when none are given.
FALLBACK = [
    "What are the data subject rights about access and portability?",
    "Under what grounds is processing of personal data lawful?",
    "When can personal data be shared with third parties?",
]


def is_question(line: Column) -> Column:
    """Ends in a question mark, or begins with Q:, a number or a capital and a stop; 3 to 40 words."""
    looks = line.endswith("?") | line.startswith("Q:") | line.rlike(r"^\d+\.") | line.rlike(r"^[A-Z]\.")
    return looks & T.word_count(line).between(LEAST_WORDS, MOST_WORDS)


def question_lines(docs: DataFrame, most: int = MOST_QUESTIONS) -> DataFrame:
    """doc_id, pos, line: the first questions of the corpus, each once, in document order."""
    rows = docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "raw")).select("doc_id", "pos", T.strip(F.col("raw")).alias("line"))
    return first_of_each(rows.where(is_question(F.col("line"))), [F.col("line")], ["doc_id", "pos"]).orderBy("doc_id", "pos").limit(most)


def fallback_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(FALLBACK)), "query_id long, text string")


def queries_or_fallback(queries: DataFrame) -> DataFrame:
    return fallback_queries(queries.sparkSession) if queries.isEmpty() else queries

"""Exact dedup by progressive refinement: length, prefix hash, full hash.

Rows are grouped by byte length; only rows whose length recurs are grouped by
the hash of a prefix as well, and only those whose prefix recurs are grouped by
the hash of the whole text.  Every step is a DataFrame aggregation with partial
sums before its shuffle.  The rows that travel hold an id, a length and hashes,
never a text.  Lengths that recur are sent to all tasks when there are at most
SMALL (counted first), so rows of a hot length stay where they are; more are
joined with salted rows.  Joins back to a hot group of copies are plain
sort-merge joins, which the adaptive planner splits.

The result lists a SHA-256 of every text, so the one scan computes it for all
rows; the decision uses it for the rows that survive both earlier steps alone.

Defined results: a null text is an empty text, and all empty texts are equal.
Of equal texts the largest id stays (null ids are smallest).  Rows that repeat
one id and text count as members each and can't be told apart, so all rows with
the id that stays are kept.  An empty table gives an empty result.  Further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.store import materialise, table

#: Characters of a text that the prefix hash covers.
PREFIX_CHARS = 256
#: Lengths that are sent to all tasks, at most; beyond that, salts of a length in the join.
SMALL, SALTS = 200_000, 16


def text_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """id, length in bytes, prefix hash and SHA-256 of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix_hash"),
        F.sha2(text, 256).alias("text_sha256"),
    )


def of_recurring_length(keys: DataFrame, small: int = SMALL) -> DataFrame:
    """The rows of keys whose length another row has."""
    lengths = materialise(keys.groupBy("n_bytes").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes"), "exact-lengths")
    if lengths.count() <= small:
        return keys.join(F.broadcast(lengths), "n_bytes", "left_semi")
    salted = lengths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keys.withColumn("salt", F.pmod(F.hash("prefix_hash"), F.lit(SALTS))).join(salted, ["n_bytes", "salt"], "left_semi").drop("salt")


def progressive_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, small: int = SMALL) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    keys = materialise(text_keys(docs, id_col, text_col, prefix_chars), "exact-keys")
    recurs = F.col("n") > 1
    same_length = of_recurring_length(keys, small)
    prefixes = same_length.groupBy("n_bytes", "prefix_hash").agg(F.count("*").alias("n")).where(recurs)
    same_prefix = same_length.join(prefixes, ["n_bytes", "prefix_hash"], "left_semi")
    groups = (
        same_prefix.groupBy("n_bytes", "prefix_hash", "text_sha256")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        .where(recurs)
    )
    grouped = keys.join(groups, ["n_bytes", "prefix_hash", "text_sha256"], "left")
    keep = F.when(F.col("n").isNotNull(), F.col("last")).otherwise(F.col("doc_id"))
    return grouped.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def op3_progressive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {"op3_progressive_dedup": op3_progressive_dedup}
ORACLES = {"op3_progressive_dedup": ORACLE}

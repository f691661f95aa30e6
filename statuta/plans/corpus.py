"""Corpora made of the star tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Normative texts: three paragraphs with a heading, a section mark, bullets and clauses.
POLICY_SQL = """
SELECT s_suppkey AS doc_id,
  'GENERAL TERMS' || chr(10) || 'Section ' || CAST(s_suppkey % 9 + 1 AS STRING) || ' Scope' || chr(10) ||
  'The ' || agent || ' based in ' || n_name || ' ' || keyword || ' keep records of site ' || CAST(s_suppkey AS STRING) || ' for ' || CAST(s_suppkey % 30 + 1 AS STRING) || ' days. Other terms are listed below.' ||
  chr(10) || chr(10) || 'Duties:' || chr(10) || '1. ' || agent || ' must report to ' || n_name || chr(10) || '- Each Report Office should answer. Is it late?' || chr(10) || '(a) the ' || lower(agent) || ' shall' || chr(10) || '  pay on time' ||
  chr(10) || chr(10) || '2.1 Payment is due. No fee applies; a Third Party ' || keyword || ' charge one.' || chr(10) || 'What does the ' || agent || ' owe?' || chr(10) || 'Q: who pays for copies' || chr(10) || '3) Closing words' AS text
FROM (SELECT s_suppkey, n_name,
        CASE s_suppkey % 3 WHEN 0 THEN 'Data Controller' WHEN 1 THEN 'Data Processor' ELSE 'Third Party' END AS agent,
        CASE s_suppkey % 5 WHEN 0 THEN 'is required to' WHEN 1 THEN 'is prohibited from' WHEN 2 THEN 'may not' WHEN 3 THEN 'Shall' ELSE 'likes to' END AS keyword
      FROM supplier JOIN nation ON s_nationkey = n_nationkey) named
"""

#: supplier - nation - region and customer - nation, with a second predicate for some pairs.
STAR_SQL = """
SELECT 'S' || CAST(s_suppkey AS STRING) AS subject, 'basedIn' AS predicate, 'N' || CAST(s_nationkey AS STRING) AS object, CAST(s_suppkey AS BIGINT) AS seq FROM supplier
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'registeredIn', 'N' || CAST(s_nationkey AS STRING), CAST(1000000000 + s_suppkey AS BIGINT) FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'residesIn', 'N' || CAST(c_nationkey AS STRING), CAST(2000000000 + c_custkey AS BIGINT) FROM customer
UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'locatedIn', 'R' || CAST(n_regionkey AS STRING), CAST(3000000000 + n_nationkey AS BIGINT) FROM nation
UNION ALL SELECT 'R' || CAST(r_regionkey AS STRING), 'listedWith', 'N' || CAST(r_regionkey AS STRING), CAST(4000000000 + r_regionkey AS BIGINT) FROM region
"""

#: Hits of chunks: every supplier (two or fewer to a chunk), customer (ten) and nation (one), and nodes of neither graph.
HITS_SQL = """
SELECT CAST(FLOOR((s_suppkey - 1) / 6) AS BIGINT) * 3 + s_suppkey % 3 AS chunk_id, 'S' || CAST(s_suppkey AS STRING) AS node_id FROM supplier
UNION ALL SELECT CAST(FLOOR(c_custkey / 10) AS BIGINT) + 1000000000, 'C' || CAST(c_custkey AS STRING) FROM customer
UNION ALL SELECT CAST(-2 - n_nationkey AS BIGINT), 'N' || CAST(n_nationkey AS STRING) FROM nation
UNION ALL SELECT 1, 'N3' FROM region WHERE r_regionkey = 0 UNION ALL SELECT 2, 'elsewhere' FROM region WHERE r_regionkey = 0
UNION ALL SELECT -1, 'nowhere' FROM region WHERE r_regionkey = 0
"""

#: Links among suppliers, as the second graph of a fusion.
EVENTIC_SQL = """
SELECT 'S' || CAST(a.s_suppkey AS STRING) AS src, 'S' || CAST(b.s_suppkey AS STRING) AS dst, 'regulates' AS rel, CAST(a.s_suppkey AS BIGINT) AS seq
FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 3
"""

#: Replies of every kind, from the labels.
REPLIES_SQL = """
SELECT doc_id AS chunk_id, CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'ok <Compliance Check Passed>'
  WHEN 3 THEN '<Compliance Check Failed> [{"fragment":"f' || CAST(doc_id AS STRING) || '","reason":"r"}]' WHEN 4 THEN '<Compliance Check Failed> no list'
  WHEN 5 THEN '<Compliance Check Failed> then <Compliance Check Passed>' WHEN 6 THEN 'Compliance Check Passed> cut short' ELSE 'a clear Violation of ' || CAST(quality AS STRING) END AS reply
FROM labels
"""

#: Predictions and gold labels, from the labels.
PREDICTIONS_SQL = "SELECT doc_id AS chunk_id, CASE WHEN toxic = 1 OR doc_id % 4 = 0 THEN 'FAIL' WHEN doc_id % 17 = 0 THEN 'unknown' ELSE 'pass' END AS verdict FROM labels"
GOLD_SQL = """
SELECT doc_id AS chunk_id, 'pass' AS label, CAST(0 AS BIGINT) AS seq FROM labels WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, CASE quality WHEN 0 THEN 'fail' ELSE 'pass' END, CAST(1 AS BIGINT) FROM labels WHERE doc_id % 5 <> 0
"""

#: Proposed boundaries: valid, overlapping, nested, reversed and out of range.
BOUNDARIES_SQL = """
SELECT doc_id, CAST(o AS INT) AS ord, CAST(CASE o WHEN 0 THEN 0 WHEN 1 THEN doc_id % 40 WHEN 2 THEN 20 WHEN 3 THEN 25 WHEN 4 THEN 30 ELSE -1 END AS INT) AS start,
  CAST(CASE o WHEN 0 THEN 30 WHEN 1 THEN doc_id % 90 WHEN 2 THEN 80 WHEN 3 THEN 35 WHEN 4 THEN 120 ELSE 10 END AS INT) AS "end", 'part ' || CAST(o AS STRING) AS title
FROM documents JOIN (SELECT 0 AS o UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) n ON 1 = 1
"""

TABLES = ["region", "nation", "customer", "supplier", "documents", "labels", "embeddings", "benchmark", "conversations"]


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the statements above."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    sql = sql.replace('"end"', "`end`").replace("{", "{{").replace("}", "}}")
    for name in frames:
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
    return spark.sql(sql, **frames)

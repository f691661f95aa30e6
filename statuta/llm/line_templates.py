"""Line dedup by a log-template tree of fixed depth.

A line is parsed into words; words with a digit become the field <*>.  The tree
has one level for the number of words and one for the first LEAD words; what
reaches the same leaf is generalised: a word stays where lines of at least
MIN_DOCS documents of the leaf have it at its position, else it becomes <*>.  A
template is dropped from all documents when it recurs in MIN_DOCS documents and
is specific: it has no generalised word, or keeps at least CONSTANT of its words
and FIXED words.

Only lines of leaves that MIN_DOCS documents reach are ever split into rows of
words, once per distinct line; all other lines travel as hashes.  Counts are
summed before their shuffles, so a line that a third of the documents share is
one row per task.  Everything is DataFrame functions.

Defined results: lines are cut at \\n; a blank line is never dropped and counts
as a line; a null text has no lines, stays null and loses nothing.  Rows that
repeat an id and text are one document to the counts and are cleaned alike;
rows of one id with other texts are other documents.  An empty table gives an
empty result.  Other columns of docs stay as they are, but for one named n_lines
or n_dropped, which the operator's own replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.store import materialise, table

MIN_DOCS = 6
LEAD = 3
CONSTANT = 0.75
FIXED = 5
#: Leaves up to this count (it is taken first) are sent to every task; more are joined by a shuffle.
SMALL = 200_000
FIELD = "<*>"
_WHITE = " \t\n\u000b\f\r"


def parsed_lines(docs: DataFrame) -> DataFrame:
    """doc_key, position, words, n, leaf, line_key of each line that has words."""
    lines = docs.select(
        F.xxhash64("doc_id", "text").alias("doc_key"),
        F.posexplode(F.split("text", "\n", -1)).alias("position", "line"),
    )
    # blank lines go by their characters: a filter on words would split every line a second time
    lines = lines.where(F.btrim("line", F.lit(_WHITE)) != "")
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", r"[^\s0-9]*[0-9]\S*", FIELD)).otherwise(F.col("line"))
    split = lines.select("doc_key", "position", F.split(F.btrim(masked, F.lit(_WHITE)), r"\s+").alias("words"))
    return split.select(
        "doc_key",
        "position",
        "words",
        F.size("words").alias("n"),
        F.xxhash64(F.size("words"), F.slice("words", 1, LEAD)).alias("leaf"),
        F.struct(F.xxhash64("words").alias("a"), F.hash("words", F.lit(1)).alias("b")).alias("line_key"),
    )


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lines without their words, keys of lines whose template recurs)."""
    lines = materialise(parsed_lines(docs).drop("words"), "template-lines")
    holders = materialise(
        lines.select("doc_key", "leaf", "line_key").distinct().groupBy("leaf", "line_key").agg(F.count("*").alias("docs")), "template-holders"
    )
    leaves = holders.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs")).where(F.col("leaf_docs") >= min_docs).select("leaf")
    leaves = materialise(leaves, "template-leaves")
    if leaves.count() <= SMALL:
        leaves = F.broadcast(leaves)
    reached = parsed_lines(docs).join(leaves, "leaf", "left_semi")
    distinct = reached.groupBy("leaf", "n", "line_key").agg(F.first("words").alias("words"))
    held = materialise(distinct.join(holders.select("line_key", "docs", F.col("leaf").alias("of")), "line_key").where("of = leaf").drop("of"), "template-words")
    words = held.select("leaf", "line_key", "docs", F.posexplode("words").alias("at", "word"))
    stay = words.groupBy("leaf", "at", "word").agg(F.sum("docs").alias("with_word")).where(F.col("with_word") >= min_docs).drop("with_word").withColumn("stays", F.lit(True))
    shaped = words.join(stay, ["leaf", "at", "word"], "left").groupBy("leaf", "line_key").agg(
        F.array_sort(F.collect_list(F.struct("at", F.when(F.col("stays"), F.col("word")).otherwise(FIELD).alias("word")))).alias("parts"),
        F.count_if(F.col("stays") & (F.col("word") != FIELD)).alias("kept"),
        F.count_if(F.col("stays").isNull()).alias("generalised"),
        F.count("*").alias("n"),
    )
    specific = (F.col("generalised") == 0) | ((F.col("kept") >= F.col("n") * CONSTANT) & (F.col("kept") >= FIXED))
    templates = shaped.where(specific).select("line_key", "leaf", F.xxhash64(F.transform("parts", lambda p: p["word"])).alias("template"))
    templates = materialise(templates, "template-of-line")
    of_doc = lines.select("doc_key", "leaf", "line_key").join(templates, ["leaf", "line_key"])
    spread = of_doc.select("doc_key", "leaf", "template").distinct().groupBy("leaf", "template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    return lines, materialise(templates.join(spread, ["leaf", "template"]).select("leaf", "line_key"), "template-recurring")


def drop_template_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with recurring lines taken out of text, and n_lines, n_dropped."""
    lines, recurring = recurring_lines(docs, min_docs)
    dropped = lines.join(recurring, ["leaf", "line_key"]).groupBy("doc_key").agg(F.collect_set("position").alias("positions"))
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("doc_key"))
    all_lines = F.split(F.col("row.text"), "\n", -1)
    joined = keyed.join(dropped, "doc_key", "left")
    kept = F.when(F.col("positions").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.filter(all_lines, lambda x, k: ~F.array_contains(F.col("positions"), k)), "\n")
    )
    return joined.select(
        *[kept.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("positions").isNull(), 0).otherwise(F.size("positions")).cast("long").alias("n_dropped"),
    )


def op8_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = drop_template_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
l AS (SELECT k, u.pos, regexp_replace(ls[u.pos], '[^\s0-9]*[0-9]\S*', '{FIELD}', 'g') AS masked FROM d, unnest(range(1, len(ls) + 1)) u(pos)),
w AS (SELECT k, pos, regexp_split_to_array(regexp_replace(masked, '^\s+|\s+$', '', 'g'), '\s+') AS words FROM l),
p AS (SELECT k, pos, words, len(words) AS n, words[1:{LEAD}] AS lead FROM w WHERE words[1] <> ''),
h AS (SELECT words, n, lead, count(DISTINCT k) AS docs FROM p GROUP BY ALL),
f AS (SELECT h.* FROM h JOIN (SELECT n, lead FROM h GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}) USING (n, lead)),
t AS (SELECT n, lead, words, docs, u.wp, words[u.wp] AS word FROM f, unnest(range(1, n + 1)) u(wp)),
s AS (SELECT n, lead, wp, word FROM t GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
g AS (SELECT t.n, t.lead, t.words, list(CASE WHEN s.word IS NULL THEN '{FIELD}' ELSE t.word END ORDER BY t.wp) AS template,
      count(*) FILTER (s.word <> '{FIELD}') AS kept, count(*) FILTER (s.word IS NULL) AS generalised
      FROM t LEFT JOIN s ON t.n = s.n AND t.lead = s.lead AND t.wp = s.wp AND t.word = s.word GROUP BY t.n, t.lead, t.words),
v AS (SELECT * FROM g WHERE generalised = 0 OR (kept >= n * {CONSTANT} AND kept >= {FIXED})),
r AS (SELECT n, lead, template FROM p JOIN v USING (n, lead, words) GROUP BY ALL HAVING count(DISTINCT k) >= {MIN_DOCS}),
x AS (SELECT p.k, list(p.pos) AS drops FROM p JOIN v USING (n, lead, words) JOIN r USING (n, lead, template) GROUP BY 1),
o AS (SELECT d.doc_id, array_to_string(d.ls, chr(10)) AS text, d.ls, x.drops FROM d LEFT JOIN x USING (k))
SELECT q.doc_id, coalesce(len(o.ls), 0) AS n_lines, coalesce(len(o.drops), 0) AS n_dropped,
       sha256(coalesce(CASE WHEN o.drops IS NULL THEN o.text ELSE array_to_string([o.ls[i] FOR i IN range(1, len(o.ls) + 1) IF NOT list_contains(o.drops, i)], chr(10)) END, '')) AS kept_sha256
FROM documents q LEFT JOIN o ON q.doc_id = o.doc_id AND q.text = o.text
"""

QUERIES = {"op8_template_lines": op8_template_lines}
ORACLES = {"op8_template_lines": ORACLE}

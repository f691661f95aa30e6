"""Queries and oracle SQL of the library, by name.

Each query runs an operator over whole tables; its oracle states the same in
DuckDB's SQL.  Queries without an oracle are sequential folds, which tests hold
against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.functions import vectors as V
from statuta.operators import boundaries, chunking, contracts, evaluation, fusion, questions, retrieval, triples, verdict
from statuta.operators.providers import hashed_embedder
from statuta.plans import corpus
from statuta.sources import triples as triple_files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
DIM = 32


def query(oracle: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _policy(spark: SparkSession, d: str) -> DataFrame:
    return corpus.run(spark, d, corpus.POLICY_SQL)


# DuckDB forms of the text expressions
def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def _pieces(marked: str) -> str:
    """Stripped, non-blank pieces between marks chr(1)."""
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: {_strip('p')}), lambda p: p <> '')"


def _windows(size: int, overlap: int, w: str = "w") -> str:
    step = chunking.step_of(size, overlap)
    return f"[{{'text': array_to_string({w}[i + 1:i + {size}], ' '), 'start_word': i, 'end_word': least(len({w}), i + {size})}} FOR i IN range(0, len({w}), {step})]"


_DEONTIC = T.DEONTIC_PATTERN
_DOC_WORDS = f"d AS (SELECT doc_id, {_words('text')} AS w FROM documents)"


def _exploded(array: str, source: str, name: str = "text") -> str:
    return f"SELECT doc_id, (u.i - 1)::INT AS pos, a[u.i] AS {name} FROM (SELECT doc_id, {array} AS a FROM {source}) t, unnest(range(1, len(a) + 1)) u(i)"


@query(f"WITH {_DOC_WORDS} SELECT doc_id, (u.i - 1)::INT AS pos, c[u.i].text AS text, c[u.i].start_word::INT AS start_word, c[u.i].end_word::INT AS end_word FROM (SELECT doc_id, {_windows(128, 16)} AS c FROM d) t, unnest(range(1, len(c) + 1)) u(i)")
def word_windows(spark, d):
    return chunking.word_windows(_docs(spark, d), 128, 16)


@query(f"WITH {_DOC_WORDS} SELECT doc_id, len(c) AS n_chunks, md5(array_to_string([x.text FOR x IN c], '|')) AS digest FROM (SELECT doc_id, {_windows(200, 50)} AS c FROM d)")
def strict_windows(spark, d):
    c = chunking.strict_window_array(F.col("text"), 200, 50)
    return _docs(spark, d).select("doc_id", F.size(c).cast("long").alias("n_chunks"), F.md5(F.array_join(F.transform(c, lambda x: x["text"]), "|").cast("binary")).alias("digest"))


@query(f"""WITH {_DOC_WORDS}, c AS (SELECT doc_id, [x.text FOR x IN {_windows(100, 20)}] AS a, len(w) AS n FROM d)
SELECT doc_id, (u.i - 1)::INT AS pos, m[u.i] AS text FROM (SELECT doc_id, CASE WHEN len(a) > 1 AND len({_words('a[-1]')}) < 30 THEN list_concat(a[1:len(a) - 2], [a[-2] || ' ' || a[-1]]) ELSE a END AS m FROM c) t, unnest(range(1, len(m) + 1)) u(i)""")
def tail_merged_windows(spark, d):
    return chunking.exploded(_docs(spark, d), chunking.merged_tail_array(F.col("text"), 100, 20, 30))


_NORMAL = _strip(r"regexp_replace(regexp_replace(text, '-\s*\n\s*', '', 'g'), '\s+', ' ', 'g')")


@query(f"SELECT doc_id, {_NORMAL} AS text FROM documents")
def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_text(F.col("text")).alias("text"))


def _sentences(x: str, marks: str = ".?!;:") -> str:
    return _pieces(rf"regexp_replace({_strip(x)}, '([{marks}])\s+', '\1' || chr(1), 'g')")


@query(_exploded(_sentences("text"), "documents"))
def sentence_split(spark, d):
    return chunking.exploded(_docs(spark, d), T.sentences(F.col("text")))


_LINES = r"regexp_split_to_array(text, '\r\n|[\n\r]')"
_BULLET = chunking.BULLET
_SEGMENT_MARK = f"""CASE WHEN {_strip('l')} = '' THEN chr(1) WHEN regexp_matches(l, '{_BULLET}') OR (length({_strip('l')}) <= 120 AND ((upper({_strip('l')}) = {_strip('l')} AND lower({_strip('l')}) <> {_strip('l')}) OR ends_with({_strip('l')}, ':')))
    THEN chr(1) || {_strip('l')} || chr(1) ELSE {_strip('l')} || chr(10) END"""
_SEGMENTS = _pieces(f"array_to_string([{_SEGMENT_MARK} FOR l IN {_LINES}], '')")


@query(_exploded(_SEGMENTS, f"({corpus.POLICY_SQL})"))
def line_segments(spark, d):
    return chunking.exploded(_policy(spark, d), chunking.segment_array(F.col("text")))


@query(_exploded(f"flatten([CASE WHEN len({_words('s')}) > 60 THEN {_sentences('s', '.!?;:' + chr(10))} ELSE [s] END FOR s IN {_SEGMENTS}])", "documents"))
def long_segments(spark, d):
    return chunking.exploded(_docs(spark, d), chunking.long_split_array(chunking.segment_array(F.col("text")), 60))


_SECTIONS = _pieces(rf"regexp_replace(text, '({chunking.SECTION.replace('(?i)', '')})', chr(1) || '\1', 'gi')")


@query(_exploded(f"flatten([CASE WHEN len({_words('s')}) <= 24 THEN [s] ELSE [x.text FOR x IN {_windows(24, 8, '(' + _words('s') + ')')}] END FOR s IN {_SECTIONS}])", f"({corpus.POLICY_SQL})"))
def section_split(spark, d):
    return chunking.exploded(_policy(spark, d), chunking.section_array(F.col("text"), 24, 8))


_CLAUSE_MARK = f"CASE WHEN regexp_matches(l, '{chunking.CLAUSE}') THEN chr(1) || {_strip('l')} || chr(1) ELSE {_strip('l')} || ' ' END"


@query(_exploded(_pieces(f"array_to_string([{_CLAUSE_MARK} FOR l IN {_LINES}], '')"), f"({corpus.POLICY_SQL})"))
def clause_split(spark, d):
    return chunking.exploded(_policy(spark, d), chunking.clause_array(F.col("text")))


_PARAS = _pieces(r"regexp_replace(text, '\n{2,}', chr(1), 'g')")


@query(_exploded(_PARAS, f"({corpus.POLICY_SQL})"))
def paragraph_split(spark, d):
    return chunking.exploded(_policy(spark, d), T.paragraphs(F.col("text")))


def _turns(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text")


_TURNS = f"t AS (SELECT conv_id AS doc_id, turn AS pos, text, {_words('text')} AS w FROM conversations)"


@query(f"""WITH {_TURNS}, n AS (SELECT *, len(w) AS n, CASE WHEN len(w) >= 12 OR row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1 THEN 1 ELSE 0 END AS s FROM t),
i AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM n),
h AS (SELECT doc_id, island, list(w ORDER BY pos)[1] AS w, list(text ORDER BY pos) AS m FROM i GROUP BY ALL),
p AS (SELECT doc_id, island, m, CASE WHEN len(w) > 30 THEN [array_to_string(w[1:len(w) // 2], ' '), array_to_string(w[len(w) // 2 + 1:], ' ')] ELSE [m[1]] END AS a FROM h),
q AS (SELECT doc_id, island, list_concat(a[1:len(a) - 1], [array_to_string(list_concat([a[-1]], m[2:]), ' ')]) AS a FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island, u.i) - 1 AS pos, a[u.i] AS text FROM q, unnest(range(1, len(a) + 1)) u(i)""")
def adaptive_size(spark, d):
    return chunking.adaptive_size(_turns(spark, d), 12, 30).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {_TURNS}, l AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM t)
SELECT doc_id, pos, array_to_string(CASE WHEN b IS NULL THEN w ELSE list_concat(b[greatest(len(b) - 4, 1):], w) END, ' ') AS text FROM l""")
def add_overlap(spark, d):
    return chunking.add_overlap(_turns(spark, d), 5)


@query(f"""WITH b AS ({corpus.BOUNDARIES_SQL}), i AS (SELECT b.*, text FROM b JOIN documents USING (doc_id) WHERE start >= 0 AND "end" > start AND "end" <= length(text)),
v AS (SELECT *, greatest(start, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start, ord), 0)) AS s FROM i),
c AS (SELECT doc_id, ord, s, "end", title, {_strip('substring(text, s + 1, greatest("end" - s, 0))')} AS piece FROM v)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s, "end", ord) - 1)::INT AS pos, piece AS text, title FROM c WHERE piece <> ''""")
def boundary_slices(spark, d):
    return boundaries.boundary_slices(_docs(spark, d), corpus.run(spark, d, corpus.BOUNDARIES_SQL))


@query()
def packed_sentences(spark, d):
    return chunking.exploded(_docs(spark, d), chunking.packed_sentence_array(F.col("text"), 100, 20))


@query()
def semantic_chunks(spark, d):
    return chunking.semantic_chunks(_docs(spark, d), hashed_embedder(DIM))


@query()
def hybrid_chunks(spark, d):
    return chunking.hybrid_chunks(_policy(spark, d), lambda c: V.hashed_embedding(T.words(c), DIM), 0.85, 10, 60, 5)


def _vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label")


@query("""WITH e AS (SELECT label AS doc_id, vec_id AS pos, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
m AS (SELECT doc_id, pos, sum(CASE WHEN coalesce(list_cosine_similarity(embedding::DOUBLE[], b::DOUBLE[]) > 0.05, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS g FROM e)
SELECT doc_id, g::INT AS pos, string_agg('v' || pos, ' ' ORDER BY pos) AS text FROM m GROUP BY doc_id, g""")
def semantic_refine(spark, d):
    rows = _vectors(spark, d).select(F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), F.concat(F.lit("v"), "vec_id").alias("text"), F.col("embedding").alias("vec"))
    return chunking.semantic_refine(rows, 0.05)


@query("SELECT a.vec_id AS chunk_id, b.vec_id AS query_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a, embeddings b WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def similarity_join(spark, d):
    v = _vectors(spark, d)
    found = retrieval.similarity_join(v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")), v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), 0.3)
    return found.select("chunk_id", "query_id", F.round("sim", 6).alias("sim"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 3""")
def knn_topk(spark, d):
    v = _vectors(spark, d)
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    found = retrieval.top_k(v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")), queries, 3)
    return found.withColumn("score", F.round("score", 6))


def _hashed(words: str) -> str:
    places = f"[(('0x' || substr(md5(x), 1, 8))::BIGINT % {DIM}) FOR x IN {words}]"
    return f"list_transform(range(0, {DIM}), lambda k: len(list_filter({places}, lambda p: p = k))::DOUBLE)"


@query(f"""WITH {_DOC_WORDS}, c AS (SELECT doc_id, u.i - 1 AS pos, a[u.i].text AS text FROM (SELECT doc_id, {_windows(128, 16)} AS a FROM d) t, unnest(range(1, len(a) + 1)) u(i)),
v AS MATERIALIZED (SELECT doc_id, pos, {_hashed("string_split(text, ' ')")} AS vec FROM c),
q AS MATERIALIZED (SELECT item_id, {_hashed(_words('text'))} AS vec FROM benchmark),
s AS (SELECT item_id, doc_id, pos, list_cosine_similarity(q.vec, v.vec) AS score FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, doc_id, pos) AS rank FROM s)
SELECT 'simple_128_ov16' AS experiment, round(avg(score), 6) AS avg_score, count(*) AS n FROM r WHERE rank <= 3""")
def retrieval_summary(spark, d):
    """Windows of 128 words, hashed embeddings, the three nearest to each benchmark item, their mean score."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), V.hashed_embedding(T.words(F.col("text")), DIM).alias("vec"))
    found = retrieval.summary(retrieval.arms_top_k(_docs(spark, d), items, [("simple_128_ov16", "simple", 128, 16)], DIM, 3))
    return found.withColumn("avg_score", F.round("avg_score", 6))


@query(f"SELECT doc_id, regexp_matches(text, '{_DEONTIC}', 'i') AS normative FROM ({corpus.POLICY_SQL})")
def deontic_filter(spark, d):
    return _policy(spark, d).select("doc_id", T.has_deontic(F.col("text")).alias("normative"))


_NOUN = T.PROPER_NOUN % 3
_NOT_FIRST = ", ".join(f"'{x}'" for x in triples.NOT_FIRST)


def _distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda e, i: NOT list_contains(({x})[1:i - 1], e))"


@query(rf"""WITH p AS ({corpus.POLICY_SQL}), a AS (SELECT doc_id, text, regexp_extract_all(text, '{_NOUN}', 1) AS f FROM p),
b AS (SELECT doc_id, text, list_filter({_distinct_in_order('f')}, lambda x: NOT list_contains([{_NOT_FIRST}], regexp_extract(x, '^(\S+)', 1))) AS agents FROM a),
s AS (SELECT doc_id, agents, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM b),
e AS (SELECT doc_id, agents, (u.i - 1)::INT AS pos, l[u.i] AS s FROM s, unnest(range(1, len(l) + 1)) u(i))
SELECT doc_id, pos, coalesce(list_filter(agents, lambda x: regexp_matches(s, '\b' || x || '\b'))[1], agents[1], 'Unknown') AS agent, regexp_extract(s, '{_DEONTIC}', 1, 'i') AS deontic,
       {_strip(f"regexp_extract(s, '^.*?{_DEONTIC}(.*)$', 2, 'is')")} AS action
FROM e WHERE regexp_matches(s, '{_DEONTIC}', 'i')""")
def heuristic_triples(spark, d):
    return triples.heuristic_triples(_policy(spark, d))


_ACTION = triples.ACTION.replace("(?i)", "")
_EVENTIC = rf"""p AS ({corpus.POLICY_SQL}), q AS (SELECT doc_id, list_filter({_PARAS}, lambda x: regexp_matches(x, '{_DEONTIC}', 'i')) AS paras FROM p),
ag AS (SELECT doc_id, paras, regexp_extract_all(array_to_string(paras, chr(10) || chr(10)), '{_NOUN}', 1) AS f FROM q),
ad AS (SELECT doc_id, paras, {_distinct_in_order('f')} AS agents FROM ag),
pe AS (SELECT doc_id, agents, (u.i - 1)::INT AS para_pos, paras[u.i] AS para FROM ad, unnest(range(1, len(paras) + 1)) u(i)),
ch AS (SELECT doc_id, para_pos, para, coalesce(list_filter(agents, lambda x: regexp_matches(para, '\b' || x || '\b', 'i'))[1], agents[1]) AS agent,
       regexp_extract_all(para, '{_ACTION}', 1, 'i') AS ds, regexp_extract_all(para, '{_ACTION}', 2, 'i') AS acts FROM pe),
tr AS (SELECT doc_id, para_pos, (u.i - 1)::INT AS match_pos, agent, ds[u.i] AS deontic, {_strip('acts[u.i]')} AS action FROM ch, unnest(range(1, len(ds) + 1)) u(i)),
ev AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY doc_id, lower(agent), lower(deontic), lower(action) ORDER BY para_pos, match_pos) = 1)"""


@query(f"WITH {_EVENTIC} SELECT * FROM ev")
def eventic_triples(spark, d):
    return triples.eventic_triples(_policy(spark, d))


def _event_rows(spark, d):
    return triples.eventic_triples(_policy(spark, d)).withColumn("seq", F.shiftleft("doc_id", 32) + F.shiftleft("para_pos", 16) + F.col("match_pos"))


@query(f"""WITH {_EVENTIC} SELECT src, dst, rel FROM (SELECT agent AS src, 'DEONTIC::' || deontic AS dst, 'has_deontic' AS rel FROM ev UNION SELECT 'DEONTIC::' || deontic, 'ACTION::' || action, 'regulates' FROM ev)""")
def eventic_edges(spark, d):
    return triples.eventic_graph(_event_rows(spark, d))[1].drop("seq")


@query(f"""WITH {_EVENTIC} SELECT type, count(*) AS n FROM (SELECT agent AS id, 'agent' AS type FROM ev UNION SELECT 'DEONTIC::' || deontic, 'deontic' FROM ev UNION SELECT 'ACTION::' || action, 'action' FROM ev) GROUP BY 1""")
def eventic_node_types(spark, d):
    return triples.eventic_graph(_event_rows(spark, d))[0].groupBy("type").agg(F.count("*").alias("n"))


_STAR_EDGES = f"st AS ({corpus.STAR_SQL}), se AS (SELECT subject AS src, object AS dst, arg_max(predicate, seq) AS predicate, min(seq) AS seq FROM st GROUP BY 1, 2)"


def _star(spark, d):
    return triples.static_graph(corpus.run(spark, d, corpus.STAR_SQL))


@query(f"WITH {_STAR_EDGES} SELECT * FROM se")
def static_edges(spark, d):
    return _star(spark, d)[1]


@query(f"WITH {_STAR_EDGES} SELECT id, id AS label, min(s) AS seq FROM (SELECT subject AS id, seq * 2 AS s FROM st UNION ALL SELECT object, seq * 2 + 1 FROM st) GROUP BY 1")
def static_nodes(spark, d):
    return _star(spark, d)[0]


_HITS = f"""{_STAR_EDGES}, sn AS (SELECT DISTINCT unnest([src, dst]) AS id FROM se), hi AS ({corpus.HITS_SQL}), an AS (SELECT * FROM hi WHERE node_id IN (SELECT id FROM sn)),
bo AS (SELECT src AS a, dst AS b FROM se UNION SELECT dst, src FROM se), h1 AS (SELECT DISTINCT chunk_id, b AS node_id FROM an JOIN bo ON node_id = a),
h2 AS (SELECT * FROM h1 UNION SELECT chunk_id, dst FROM h1 JOIN se ON node_id = src), h3 AS (SELECT * FROM h2 UNION SELECT chunk_id, dst FROM h2 JOIN se ON node_id = src)"""


def _hits(spark, d):
    return corpus.run(spark, d, corpus.HITS_SQL)


@query(f"WITH {_HITS} SELECT * FROM an")
def anchors(spark, d):
    return fusion.anchors(_hits(spark, d), _star(spark, d)[0])


@query(f"WITH {_HITS} SELECT * FROM h1")
def neighbours_one_hop(spark, d):
    nodes, edges = _star(spark, d)
    return fusion.neighbours(fusion.anchors(_hits(spark, d), nodes), edges, 1)


@query(f"WITH {_HITS} SELECT * FROM h3")
def neighbours_three_hops(spark, d):
    nodes, edges = _star(spark, d)
    return fusion.neighbours(fusion.anchors(_hits(spark, d), nodes), edges, 3)


_FUSED = f"""{_HITS}, ee AS ({corpus.EVENTIC_SQL}), fu AS (SELECT chunk_id, node_id FROM hi UNION SELECT * FROM h1),
ei AS (SELECT f.chunk_id, src, dst, rel, seq FROM ee JOIN fu f ON f.node_id = src JOIN fu g ON g.node_id = dst AND g.chunk_id = f.chunk_id),
si AS (SELECT f.chunk_id, src, dst, predicate, seq FROM se JOIN fu f ON f.node_id = src JOIN fu g ON g.node_id = dst AND g.chunk_id = f.chunk_id)"""


def _eventic(spark, d):
    edges = corpus.run(spark, d, corpus.EVENTIC_SQL)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("type", F.lit("agent"))
    return nodes, edges


@query(f"WITH {_FUSED} SELECT chunk_id, src, dst, predicate FROM si")
def induced_edges(spark, d):
    nodes, edges = _star(spark, d)
    hits = _hits(spark, d)
    fused = fusion.fused_nodes(hits, fusion.neighbours(fusion.anchors(hits, nodes), edges, 1))
    return fusion.induced_edges(fused, edges).select("chunk_id", "src", "dst", "predicate")


@query(f"""WITH {_FUSED}, m AS (SELECT chunk_id, src, dst, coalesce(predicate, rel) AS verb, ei.seq IS NULL AS later, coalesce(ei.seq, si.seq) AS seq FROM ei FULL JOIN si USING (chunk_id, src, dst)),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY later, seq, src, dst) AS k FROM m),
t AS (SELECT chunk_id, string_agg('- ' || src || ' ' || verb || ' ' || dst, chr(10) ORDER BY k) AS triples_text FROM r WHERE k <= 5 GROUP BY 1),
u AS (SELECT chunk_id, string_agg('- ' || node_id, chr(10) ORDER BY node_id) AS triples_text FROM fu WHERE chunk_id NOT IN (SELECT chunk_id FROM m) GROUP BY 1),
l AS (SELECT chunk_id, list_sort(list(DISTINCT node_id)) AS x FROM hi GROUP BY 1), a AS (SELECT chunk_id, list_sort(list(DISTINCT node_id)) AS x FROM an GROUP BY 1), h AS (SELECT chunk_id, list_sort(list(DISTINCT node_id)) AS x FROM h1 GROUP BY 1)
SELECT chunk_id, array_to_string(l.x, ',') AS hits, coalesce(array_to_string(a.x, ','), '') AS anchors, coalesce(array_to_string(h.x, ','), '') AS neighbours, triples_text
FROM l LEFT JOIN a USING (chunk_id) LEFT JOIN h USING (chunk_id) LEFT JOIN (SELECT * FROM t UNION ALL SELECT * FROM u) USING (chunk_id)""")
def fused_subgraph(spark, d):
    out = fusion.fuse(_hits(spark, d), _eventic(spark, d), _star(spark, d), 1, 5)
    return out.select("chunk_id", *[F.array_join(c, ",").alias(c) for c in ("hits", "anchors", "neighbours")], "triples_text")


@query(rf"""WITH r AS ({corpus.REPLIES_SQL}), s AS (SELECT *, {_strip("split_part(reply, '" + verdict.FAILED + "', -1)")} AS suffix FROM r)
SELECT chunk_id, CASE WHEN reply IS NULL OR reply = '' THEN 'unknown' WHEN contains(reply, '{verdict.PASSED}') THEN 'pass' WHEN contains(reply, '{verdict.FAILED}') OR regexp_matches(lower(reply), 'failed|violate|violation') THEN 'fail' ELSE 'pass' END AS verdict,
 CASE WHEN reply IS NULL OR reply = '' OR contains(reply, '{verdict.PASSED}') THEN '' WHEN contains(reply, '{verdict.FAILED}') THEN CASE WHEN suffix LIKE '[%' THEN json_extract_string(suffix, '$[0].fragment') || '/' || json_extract_string(suffix, '$[0].reason') ELSE suffix END ELSE reply[1:400] END AS proof FROM s""")
def verdict_parse(spark, d):
    rows = verdict.with_verdicts(corpus.run(spark, d, corpus.REPLIES_SQL))
    shown = F.array_join(F.transform("evidence", lambda e: F.coalesce(e["raw"], F.concat_ws("/", e["fragment"], e["reason"]))), ";")
    return rows.select("chunk_id", "verdict", shown.alias("proof"))


_PAIRS = f"p AS ({corpus.PREDICTIONS_SQL}), g AS (SELECT chunk_id, arg_max(label, seq) AS label FROM ({corpus.GOLD_SQL}) GROUP BY 1), j AS (SELECT chunk_id, (lower(label) = 'fail')::INT AS y, (lower(verdict) = 'fail')::INT AS yhat FROM p JOIN g USING (chunk_id))"


def _labels(spark, d):
    return corpus.run(spark, d, corpus.PREDICTIONS_SQL), corpus.run(spark, d, corpus.GOLD_SQL)


@query(f"WITH {_PAIRS} SELECT * FROM j")
def paired_labels(spark, d):
    return evaluation.paired(*_labels(spark, d))


@query(f"""WITH {_PAIRS}, c AS (SELECT count(*) AS n, count(*) FILTER (y = 0 AND yhat = 0) AS tn, count(*) FILTER (y = 0 AND yhat = 1) AS fp, count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 1 AND yhat = 1) AS tp FROM j)
SELECT n, tn, fp, fn, tp, (tn + tp)::DOUBLE / n AS accuracy, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc, (SELECT count(*) FROM p WHERE verdict = 'unknown') AS unknown FROM c""")
def evaluation_report(spark, d):
    return evaluation.report(*_labels(spark, d)).withColumn("mcc", F.round("mcc", 9))


@query(f"""WITH {_PAIRS}, c AS (SELECT chunk_id % 7 AS part, count(*) FILTER (y = 0 AND yhat = 0) AS tn, count(*) FILTER (y = 0 AND yhat = 1) AS fp, count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 1 AND yhat = 1) AS tp FROM (SELECT chunk_id, CASE WHEN chunk_id % 7 < 2 THEN 0 ELSE y END AS y, CASE WHEN chunk_id % 7 IN (1, 2) THEN 0 ELSE yhat END AS yhat FROM j) GROUP BY 1),
s AS (SELECT *, tp + fn = 0 OR tn + fp = 0 OR tp + fp = 0 OR tn + fn = 0 AS single, sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS root FROM c),
m AS (SELECT *, CASE WHEN root = 0 THEN 0.0 ELSE round((tp::DOUBLE * tn - fp::DOUBLE * fn) / root, 9) END AS plain FROM s)
SELECT part, plain AS sklearn, CASE WHEN single THEN 'NaN' ELSE 'number' END AS nan_policy, CASE WHEN single THEN CASE WHEN fp + fn = 0 THEN 1.0 ELSE 0.0 END ELSE plain END AS perfect, plain AS formula FROM m""")
def mcc_policies(spark, d):
    part = F.col("chunk_id") % 7
    pairs = evaluation.paired(*_labels(spark, d)).select(part.alias("part"), F.when(part < 2, 0).otherwise(F.col("y")).alias("y"), F.when(part.isin(1, 2), 0).otherwise(F.col("yhat")).alias("yhat"))
    cell = lambda y, p: F.count_if((F.col("y") == y) & (F.col("yhat") == p))
    c = pairs.groupBy("part").agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    cells = [F.col(x) for x in ("tn", "fp", "fn", "tp")]
    value = {p: F.round(evaluation.mcc(*cells, p), 9) for p in evaluation.POLICIES}
    return c.select("part", value["sklearn"].alias("sklearn"), F.when(F.isnan(value["nan"]), "NaN").otherwise("number").alias("nan_policy"), value["perfect-if-match"].alias("perfect"), value["formula-zero-div-is-0"].alias("formula"))


@query(f"SELECT chunk_id, verdict AS label FROM ({corpus.PREDICTIONS_SQL})")
def gold_projection(spark, d):
    return verdict.gold_from_predictions(_labels(spark, d)[0])


@query("SELECT doc_id, translate(substring(text, 1, 300), chr(10), ' ') AS snippet, CASE WHEN length(text) > 2000 THEN substring(text, 1, 2000) || chr(10) || chr(10) || '[TRUNCATED]' ELSE text END AS shown FROM documents")
def prompt_texts(spark, d):
    return _docs(spark, d).select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.truncated(F.col("text")).alias("shown"))


@query(rf"""WITH l AS (SELECT doc_id, (u.i - 1)::INT AS pos, {_strip('a[u.i]')} AS line FROM (SELECT doc_id, {_LINES} AS a FROM ({corpus.POLICY_SQL})) t, unnest(range(1, len(a) + 1)) u(i)),
q AS (SELECT * FROM l WHERE (ends_with(line, '?') OR starts_with(line, 'Q:') OR regexp_matches(line, '^\d+\.') OR regexp_matches(line, '^[A-Z]\.')) AND len({_words('line')}) BETWEEN 3 AND 40 QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1)
SELECT doc_id, pos, line FROM q ORDER BY doc_id, pos LIMIT 50""")
def question_lines(spark, d):
    return questions.question_lines(_policy(spark, d))


@query("""WITH d AS (SELECT doc_id, text, [[0, 30], [doc_id % 20, 50], [5, 5]] AS spans FROM documents),
n AS (SELECT doc_id, text, spans, unnest([{'h': 'h1', 'c': 'Entailment', 's': [0, 1]}, {'h': 'h2', 'c': 'Contradiction', 's': [1, 7, -1]}, {'h': 'h9', 'c': 'Other', 's': [0]}, {'h': 'h1b', 'c': 'NotMentioned', 's': [2]}]) AS a FROM d),
t AS (SELECT doc_id, a, regexp_replace(array_to_string([substring(text, (spans[i + 1][1] + 1)::BIGINT, (spans[i + 1][2] - spans[i + 1][1])::BIGINT) FOR i IN a.s IF i >= 0 AND i < 3], ' '), '^\\s+|\\s+$', '', 'g') AS target FROM n)
SELECT CASE a.h WHEN 'h1' THEN 'first' WHEN 'h2' THEN 'second' ELSE a.h END AS reference_clause, target AS target_clause, CASE a.c WHEN 'Entailment' THEN 'compliant' WHEN 'Contradiction' THEN 'noncompliant' WHEN 'NotMentioned' THEN 'uncertain' END AS compliance, 'doc' || doc_id AS source_file FROM t WHERE target <> ''""")
def contract_flatten(spark, d):
    note = lambda c, *s: F.struct(F.lit(c).alias("choice"), F.array(*[F.lit(x) for x in s]).alias("spans"))
    notes = F.create_map(F.lit("h1"), note("Entailment", 0, 1), F.lit("h2"), note("Contradiction", 1, 7, -1), F.lit("h9"), note("Other", 0), F.lit("h1b"), note("NotMentioned", 2))
    spans = F.array(F.array(F.lit(0), F.lit(30)), F.array((F.col("doc_id") % 20).cast("int"), F.lit(50)), F.array(F.lit(5), F.lit(5)))
    doc = F.struct(F.concat(F.lit("doc"), "doc_id").alias("file_name"), "text", spans.alias("spans"), F.array(F.struct(notes.alias("annotations"))).alias("annotation_sets"))
    labels = F.create_map(F.lit("h1"), F.struct(F.lit("first").alias("hypothesis")), F.lit("h2"), F.struct(F.lit("second").alias("hypothesis")))
    return contracts.flatten_contracts(_docs(spark, d).select(labels.alias("labels"), F.array(doc).alias("documents")))


_LISTED = "'[{\"subject\":\"N' || n_nationkey || '\",\"predicate\":\"in\",\"object\":\"R' || n_regionkey || '\"},{\"s\":\"a\",\"p\":\"\",\"pred\":\"q\",\"obj\":\"b\"},{\"s\":\"\",\"p\":\"x\",\"o\":\"y\"}]'"
_KEYED = "'{\"N' || n_nationkey || '\":{\"p\":[\"x\",\"y\"],\"q\":\"z\"},\"L\":[\"m\",\"n\"],\"V\":' || n_regionkey || '}'"


@query("""WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation),
t AS (SELECT k, unnest(CASE WHEN k % 2 = 0 THEN [['N' || k, 'in', 'R' || r], ['a', 'q', 'b']] ELSE [['N' || k, 'p', 'x'], ['N' || k, 'p', 'y'], ['N' || k, 'q', 'z'], ['L', 'relatedTo', 'm'], ['L', 'relatedTo', 'n'], ['V', 'hasValue', r::VARCHAR]] END) AS x FROM n)
SELECT x[1] AS subject, x[2] AS predicate, x[3] AS object, 'f' || k AS source_file FROM t""")
def json_triples(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    text = F.when(F.col("n_nationkey") % 2 == 0, F.expr(_LISTED.replace("|| n_nationkey", "|| cast(n_nationkey as string)"))).otherwise(F.expr(_KEYED))
    return triple_files.triples_from_json(nation.select(F.concat(F.lit("f"), "n_nationkey").alias("source_file"), text.alias("value"))).drop("seq")


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation), t AS (SELECT k, unnest(CASE WHEN k % 2 = 0 THEN [['s' || k, 'p', 'a, b'], ['t', 'relatedTo', '']] ELSE [['first', 'x', 'y'], ['s' || k, 'p', 'a, b'], ['t', 'relatedTo', '']] END) AS x FROM n)
SELECT x[1] AS subject, x[2] AS predicate, x[3] AS object, 'f' || k AS source_file FROM t""")
def csv_triples(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    head = F.when(F.col("n_nationkey") % 2 == 0, "My Subject,predicate,object\n").otherwise("first,x,y\n")
    body = F.concat(head, F.lit("s"), F.col("n_nationkey").cast("string"), F.lit(', p ,"a, b"\nt, ,\nonly,two\n ,p,o\n'))
    return triple_files.triples_from_delimited(nation.select(F.concat(F.lit("f"), "n_nationkey").alias("source_file"), body.alias("value"))).drop("seq")


@query(f"""WITH {_DOC_WORDS}, c AS (SELECT doc_id, u.i - 1 AS pos FROM (SELECT doc_id, {_windows(128, 16)} AS a FROM d) t, unnest(range(1, len(a) + 1)) u(i))
SELECT doc_id, pos::INT AS pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id FROM c""")
def chunk_ids(spark, d):
    return chunking.with_chunk_ids(chunking.word_windows(_docs(spark, d), 128, 16)).select("doc_id", "pos", F.col("chunk_id").cast("long"))


_ARMS = " UNION ALL ".join(f"SELECT 'simple_{s}_ov{o}' AS experiment, doc_id, ceil(len(w) / {chunking.step_of(s, o)}.0)::BIGINT AS n FROM d" for s in retrieval.SIZES for o in retrieval.OVERLAPS)


@query(f"WITH {_DOC_WORDS} SELECT experiment, sum(n)::BIGINT AS n_chunks FROM ({_ARMS}) GROUP BY 1")
def experiment_windows(spark, d):
    rows = retrieval.experiment_chunks(_docs(spark, d)).where(F.col("experiment").startswith("simple"))
    return rows.groupBy("experiment").agg(F.count("*").alias("n_chunks"))


@query()
def experiment_arms(spark, d):
    return retrieval.experiment_places(_docs(spark, d)).groupBy("experiment").agg(F.count("*").alias("n_chunks"))


@query()
def experiment_summary(spark, d):
    queries = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.summary(retrieval.run_experiment(_docs(spark, d), queries, DIM))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)

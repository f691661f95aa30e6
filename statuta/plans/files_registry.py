"""Queries through files, models and whole runs, with their oracles.

Files are written from the tables into the shared folder and read back; models are
deterministic functions that SQL can state, too.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.functions import vectors as V
from statuta.operators import chunking, compliance, contracts, evaluation, providers, questions, retrieval, triples, verdict
from statuta.operators.providers import hashed_embedder
from statuta.plans import corpus
from statuta.plans import registry as R
from statuta.sources import files, sinks
from statuta.sources import triples as triple_files
from statuta.sources.scratch import scratch, write_files, written
from statuta.streaming import stateless

query = R.query

#: Fixture files: name and kind by supplier; a blank one, and one with bytes that UTF-8 and cp1252 don't have.
_KINDS = """SELECT s_suppkey AS k, s_name || ' café ' || CAST(s_nationkey AS STRING) AS line,
  CASE s_suppkey % 6 WHEN 0 THEN 'a.txt' WHEN 1 THEN 'b.md' WHEN 2 THEN 'c.pdf' WHEN 3 THEN 'd.log' WHEN 4 THEN 'e.txt' ELSE 'f.PDF' END AS ext FROM supplier"""


def made_pdf(pages: list[str]) -> bytes:
    """A small PDF with a line of text on each page."""
    kids = b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages))]
    for i, page in enumerate(pages):
        content = zlib.compress(b"BT /F1 12 Tf (" + page.encode("cp1252") + b") Tj ET")
        objects += [b"<< /Type /Page /Contents %d 0 R >>" % (4 + 2 * i), b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(content), content)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"%%EOF"


def _folder(spark, d) -> str:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = [], []
            for k, line, ext in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names.append(f"{k:08d}{ext}")
                contents.append({"a.txt": line.encode(), "b.md": line.encode("cp1252"), "c.pdf": made_pdf([line, "", "two"]), "d.log": line.encode() + b"\x81", "e.txt": b" \n\t", "f.PDF": b"no pdf"}[ext])
            yield pa.RecordBatch.from_pydict({"name": names, "content": pa.array(contents, pa.binary())})

    path = scratch(spark, "documents")
    write_files(corpus.run(spark, d, _KINDS).mapInArrow(task, "name string, content binary"), path)
    return path


_FILE_TEXT = f"""x AS ({_KINDS}), t AS (SELECT lpad(CAST(k AS VARCHAR), 8, '0') || ext AS filename, CASE ext WHEN 'c.pdf' THEN line || chr(10) || 'two' ELSE line END AS text, ext FROM x WHERE ext NOT IN ('e.txt', 'f.PDF'))"""


@query(f"WITH {_FILE_TEXT} SELECT row_number() OVER (ORDER BY filename) - 1 AS doc_id, filename, text FROM t")
def file_documents(spark, d):
    """Text in two encodings, PDF, other extensions; blank and broken files drop out of the numbering."""
    return files.read_documents(spark, _folder(spark, d))


@query(f"""WITH {_FILE_TEXT}, p AS (SELECT filename, CASE ext WHEN 'c.pdf' THEN replace(text, chr(10) || 'two', 'two') ELSE text END AS text FROM t WHERE ext <> 'd.log')
SELECT row_number() OVER (ORDER BY filename) - 1 AS doc_id, filename, text FROM p""")
def known_file_documents(spark, d):
    """Known extensions only; pages joined by nothing, empty ones kept."""
    return files.read_documents(spark, _folder(spark, d), other_extensions=False, joiner="", drop_empty=False)


_NT = """'<n:' || n_nationkey || '> <in> "R' || n_regionkey || '"@en .' || chr(10) || '# note' || chr(10) || '_:b' || n_nationkey || ' <in> <r:1> .' || chr(10) || 'no triple'"""


@query("SELECT unnest(['n:' || n_nationkey, '_:b' || n_nationkey]) AS subject, 'in' AS predicate, unnest(['R' || n_regionkey, 'r:1']) AS object, 'f' || n_nationkey AS source_file, unnest([0, 1]) AS seq FROM nation")
def nt_triples(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    text = F.expr(_NT.replace("|| n_nationkey", "|| cast(n_nationkey as string)").replace("|| n_regionkey", "|| cast(n_regionkey as string)").replace("chr(10)", "char(10)"))
    return triple_files.triples_from_nt(nation.select(F.concat(F.lit("f"), "n_nationkey").alias("source_file"), text.alias("value")))


def _triple_folder(spark, d) -> str:
    n, key, region = spark.read.parquet(f"{d}/nation.parquet"), F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    kinds = [
        ("a", "json", F.concat(F.lit('[{"s":"N'), key, F.lit('","p":"first","o":"R'), region, F.lit('"},{"subject":"x","pred":"p","obj":"y"}]'))),
        ("b", "csv", F.concat(F.lit("subject,predicate,object\nN"), key, F.lit(",second,R"), region, F.lit("\nx,late"), key, F.lit(",y\n"))),
        ("c", "tsv", F.concat(F.lit("N"), key, F.lit("\tthird\tT"), region)),
        ("d", "ttl", F.concat(F.lit("@prefix e: <u:> .\ne:N"), key, F.lit(' e:in e:R'), region, F.lit(' ; a e:Nation .\n'))),
        ("e", "jsonld", F.concat(F.lit('{"@id":"u:J'), key, F.lit('","u:in":["R'), region, F.lit('","x"]}'))),
        ("f", "owl", F.concat(F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="u:"><rdf:Description rdf:about="u:X'), key, F.lit('"><e:in>R'), region, F.lit("</e:in></rdf:Description></rdf:RDF>"))),
        ("g", "txt", F.lit("not read")),
        ("h", "json", F.lit("{broken")),
    ]
    path = scratch(spark, "static")
    for letter, ext, content in kinds:
        write_files(n.select(F.concat(F.lit(letter), F.lpad(key, 3, "0"), F.lit(f".{ext}")).alias("name"), content.alias("content")), path)
    return path


_FOLDER_TRIPLES = """n AS (SELECT n_nationkey AS k, n_nationkey::VARCHAR AS key, n_regionkey::VARCHAR AS r FROM nation),
t AS (SELECT 'a' AS f, k, unnest([0, 1]) AS i, unnest(['N' || key, 'x']) AS s, unnest(['first', 'p']) AS p, unnest(['R' || r, 'y']) AS o FROM n
UNION ALL SELECT 'b', k, unnest([0, 1]), unnest(['N' || key, 'x']), unnest(['second', 'late' || key]), unnest(['R' || r, 'y']) FROM n
UNION ALL SELECT 'c', k, 0, 'N' || key, 'third', 'T' || r FROM n
UNION ALL SELECT 'd', k, unnest([0, 1]), 'u:N' || key, unnest(['u:in', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']), unnest(['u:R' || r, 'u:Nation']) FROM n
UNION ALL SELECT 'e', k, unnest([0, 1]), 'u:J' || key, 'u:in', unnest(['R' || r, 'x']) FROM n
UNION ALL SELECT 'f', k, 0, 'u:X' || key, 'u:in', 'R' || r FROM n)"""


@query(f"WITH {_FOLDER_TRIPLES} SELECT s AS subject, p AS predicate, o AS object, f || lpad(k::VARCHAR, 3, '0') AS file, i::BIGINT AS place FROM t")
def static_folder_triples(spark, d):
    """JSON, CSV, TSV, Turtle, JSON-LD and RDF/XML files; a file that is broken or of no known kind gives nothing."""
    rows = triple_files.read_static_folder(spark, _triple_folder(spark, d))
    return rows.select("subject", "predicate", "object", T.file_stem(F.col("source_file")).alias("file"), F.col("seq").bitwiseAND(F.lit((1 << 32) - 1)).alias("place"))


@query(f"WITH {_FOLDER_TRIPLES} SELECT s AS src, o AS dst, arg_max(p, lpad(f || lpad(k::VARCHAR, 3, '0'), 4, '0') || i) AS predicate FROM t GROUP BY 1, 2")
def static_folder_edges(spark, d):
    """Of an edge's predicates the last stays, by file and then place."""
    return triples.static_graph(triple_files.read_static_folder(spark, _triple_folder(spark, d)))[1].drop("seq")


@query("SELECT unnest(['DataController', 'DataProcessor']) AS src, 'PersonalData' AS dst, unnest(['controls', 'processes']) AS predicate")
def toy_graph(spark, d):
    none = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 0").selectExpr("n_name as subject", "n_name as predicate", "n_name as object", "n_name as source_file", "cast(n_nationkey as long) as seq")
    return triples.graph_or_toy(none)[1].drop("seq")


@query(f"WITH {R._DOC_WORDS}, c AS (SELECT doc_id, u.i - 1 AS pos, a[u.i].text AS text FROM (SELECT doc_id, {R._windows(256, 16)} AS a FROM d) t, unnest(range(1, len(a) + 1)) u(i)) SELECT doc_id, pos::INT AS pos, text FROM c")
def chunk_rows_file(spark, d):
    """Chunks written as JSON lines and read again."""
    path = scratch(spark, "chunks")
    sinks.write_json(chunking.word_windows(R._docs(spark, d), 256, 16).select("doc_id", "pos", "text"), path)
    return sinks.read_rows(spark, path, "doc_id long, pos int, text string")


@query("SELECT row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS chunk_id, n_regionkey::BIGINT AS doc_id, 'r' || n_regionkey AS filename, n_name AS text FROM nation")
def chunk_array_files(spark, d):
    """JSON arrays of chunks: a chunk's place is its id."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    item = F.to_json(F.struct(F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("r"), "n_regionkey").alias("filename"), F.col("n_name").alias("text")))
    arrays = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("item")))).alias("items"))
    path = scratch(spark, "chunk-arrays")
    write_files(arrays.select(F.concat(F.lit("r"), "n_regionkey", F.lit(".json")).alias("name"), F.concat(F.lit("[\n"), F.array_join(F.col("items.item"), ",\n"), F.lit("]")).alias("content")), path)
    return files.read_chunks(spark, path).drop("meta")


@query(f"WITH {R._STAR_EDGES} SELECT src, dst, predicate FROM se")
def graph_files(spark, d):
    nodes, edges = R._star(spark, d)
    path = scratch(spark, "graph")
    sinks.write_graph(nodes, edges, path)
    return sinks.read_graph(spark, path)[1].drop("seq")


@query(f"WITH {R._EVENTIC}, e AS (SELECT DISTINCT doc_id, agent AS src, 'DEONTIC::' || deontic AS dst FROM ev) SELECT doc_id, src, dst FROM e")
def document_graph_files(spark, d):
    """The eventic edges of each document in a folder of its own."""
    rows = R._event_rows(spark, d)
    links = written(rows.select("doc_id", F.col("agent").alias("src"), F.concat(F.lit("DEONTIC::"), "deontic").alias("dst")).distinct(), "document-links")
    path = scratch(spark, "document-graphs")
    sinks.write_graph(links.select("doc_id", F.col("src").alias("id")).distinct(), links, path, partition_by="doc_id")
    return sinks.read_folders(spark, f"{path}/edges", links.drop("doc_id").schema, "doc_id").select("doc_id", "src", "dst")


@query("""WITH u AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * 3 / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y * 9)))) AS v FROM embeddings)
SELECT id, round(list_sum(v), 5) AS total, round(v[1], 5) AS first, list_position(v, list_max(v)) - 1 AS largest FROM u""")
def vector_files(spark, d):
    """Vectors written, read as unit vectors; their largest place."""
    rows = R._vectors(spark, d).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * 3).alias("vec"))
    path = scratch(spark, "vectors")
    sinks.write_vectors(rows, path)
    v = sinks.read_vectors(spark, path)
    return v.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.get("vec", 0), 5).alias("first"), V.argmax(F.col("vec")).alias("largest"))


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT id, round(list_sum(list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 0.5))), 5) AS total FROM v""")
def unit_with_epsilon(spark, d):
    u = V.unit(F.col("embedding"), 0.5)
    return R._vectors(spark, d).select(F.col("vec_id").alias("id"), F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS query_id, n_nationkey || '. What of ' || n_name || '?' AS text FROM nation WHERE n_nationkey % 5 <> 0")
def query_file(spark, d):
    """Blank lines go, numbering stays."""
    line = F.when(F.col("n_nationkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("n_nationkey").cast("string"), F.lit(". What of "), "n_name", F.lit("? ")))
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))).alias("x"))
    path = scratch(spark, "queries")
    write_files(rows.select(F.lit("q.txt").alias("name"), F.array_join(F.col("x.line"), "\n").alias("content")), path)
    return files.read_queries(spark, f"{path}/q.txt")


@query("SELECT unnest([0, 1, 2])::BIGINT AS query_id, unnest([" + ", ".join(f"'{q}'" for q in questions.FALLBACK) + "]) AS text")
def fallback_queries(spark, d):
    none = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 0").selectExpr("cast(n_nationkey as long) as query_id", "n_name as text")
    return questions.queries_or_fallback(none)


@query("""SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'hyp ' || n_nationkey ELSE 'h' END AS reference_clause, n_name AS target_clause, 'compliant' AS compliance, s || n_nationkey AS source_file
FROM nation, (SELECT unnest(['train', 'test']) AS s) x WHERE n_nationkey > 0""")
def contract_files(spark, d):
    """Splits that exist, one after another; evidence that is empty has no row."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    key = F.col("n_nationkey").cast("string")
    labels = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("h"), F.struct(F.concat(F.lit("hyp "), key).alias("hypothesis")))).otherwise(F.create_map().cast("map<string,struct<hypothesis:string>>"))
    end = F.when(F.col("n_nationkey") > 0, F.length("n_name")).otherwise(0)
    path = scratch(spark, "contracts")
    for split in ("train", "test"):
        notes = F.create_map(F.lit("h"), F.struct(F.lit("Entailment").alias("choice"), F.array(F.lit(0)).alias("spans")))
        doc = F.struct(F.concat(F.lit(split), key).alias("file_name"), F.col("n_name").alias("text"), F.array(F.array(F.lit(0), end)).alias("spans"), F.array(F.struct(notes.alias("annotations"))).alias("annotation_sets"))
        write_files(n.select(F.concat(key, F.lit(".json")).alias("name"), F.to_json(F.struct(labels.alias("labels"), F.array(doc).alias("documents"))).alias("content")), f"{path}/{split}.json")
    return contracts.flatten_contracts(files.read_contracts(spark, path))


def _array_files(rows: DataFrame, by, order: str, item, path: str) -> None:
    arrays = rows.groupBy(by.alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("a"), item.alias("b")))).alias("x"))
    write_files(arrays.select(F.concat(F.lit("p"), F.col("block").cast("string"), F.lit(".json")).alias("name"), F.concat(F.lit("["), F.array_join(F.col("x.b"), ","), F.lit("]")).alias("content")), path)


@query(f"WITH {R._PAIRS} SELECT * FROM j")
def label_files(spark, d):
    """Predictions and gold labels as JSON arrays, read and paired."""
    predictions, gold = R._labels(spark, d)
    path = scratch(spark, "labels")
    block = F.col("chunk_id") % 4
    _array_files(predictions, block, "chunk_id", F.to_json(F.struct("chunk_id", "verdict")), f"{path}/predictions")
    ranked = gold.withColumn("place", F.col("chunk_id") * 2 + F.col("seq"))
    _array_files(ranked, block, "place", F.to_json(F.struct("chunk_id", "label")), f"{path}/gold")
    return evaluation.paired(files.read_predictions(spark, f"{path}/predictions"), files.read_gold(spark, f"{path}/gold"))


@query("SELECT (row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1)::BIGINT AS chunk_id, CASE quality WHEN 1 THEN 'fail' ELSE 'pass' END AS label FROM labels")
def bare_gold_files(spark, d):
    """Arrays of bare numbers: the place is the chunk, 1 is fail and 0 is pass."""
    path = scratch(spark, "bare-gold")
    _array_files(spark.read.parquet(f"{d}/labels.parquet"), F.col("doc_id") % 3, "doc_id", F.col("quality").cast("string"), path)
    return files.read_gold(spark, path).drop("seq")


@query(f"SELECT chunk_id, verdict AS label FROM ({corpus.PREDICTIONS_SQL})")
def gold_file(spark, d):
    path = scratch(spark, "gold")
    sinks.write_json(verdict.gold_from_predictions(R._labels(spark, d)[0]), path)
    return sinks.read_rows(spark, path, "chunk_id long, label string")


@query("""WITH s AS (SELECT q.vec_id AS query, c.vec_id AS chunk, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, chunk) AS rank FROM s)
SELECT 'flat' AS experiment, query::VARCHAR AS query, rank::INT AS rank, round(score, 6) AS score, 'a "quoted", text ' || chunk AS chunk_text_snippet, 'v' || chunk AS chunk_doc FROM r WHERE rank <= 3""")
def retrieval_csv(spark, d):
    """Retrieval rows as CSV with a header and quoted text, read again."""
    found = R.knn_topk(spark, d).select(F.lit("flat").alias("experiment"), F.col("query_id").alias("query"), "rank", "score", F.concat(F.lit('a "quoted", text '), "chunk_id").alias("chunk_text_snippet"), F.concat(F.lit("v"), "chunk_id").alias("chunk_doc"))
    path = scratch(spark, "retrieval")
    sinks.write_csv(found, path, sinks.RETRIEVAL_COLUMNS)
    return spark.read.option("header", True).option("escape", '"').schema("experiment string, query string, rank int, score double, chunk_text_snippet string, chunk_doc string").csv(path)


@query("SELECT 'topic' || label AS experiment, round(avg(list_sum(embedding::DOUBLE[])), 5) AS avg_score, count(*) AS n FROM embeddings GROUP BY 1")
def summary_file(spark, d):
    scores = R._vectors(spark, d).select(F.concat(F.lit("topic"), "label").alias("experiment"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("score"))
    path = scratch(spark, "summary")
    sinks.write_summary(retrieval.summary(scores), path)
    return sinks.read_rows(spark, path, "experiment string, avg_score double, n long").withColumn("avg_score", F.round("avg_score", 5))


@query(f"""WITH p AS ({corpus.POLICY_SQL}), d AS (SELECT doc_id, {R._words('text')} AS w FROM p)
SELECT e AS experiment, doc_id, (u.i - 1)::INT AS pos, c[u.i].text AS text FROM (SELECT 'w32' AS e, doc_id, {R._windows(32, 8)} AS c FROM d UNION ALL SELECT 'w16', doc_id, {R._windows(16, 4)} FROM d) t, unnest(range(1, len(c) + 1)) u(i)""")
def experiment_chunk_files(spark, d):
    """Chunks of two arms, a folder for each arm."""
    p = R._policy(spark, d)
    arms = [chunking.word_windows(p, n, n // 4).select(F.lit(f"w{n}").alias("experiment"), "doc_id", "pos", "text") for n in (32, 16)]
    path = scratch(spark, "experiments")
    sinks.write_json(arms[0].unionByName(arms[1]), path, "experiment")
    return spark.read.schema("doc_id long, pos int, text string, experiment string").json(path)


@query(r"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array('["' || s[1] || '", ' || coalesce(s[2], '') || ';' || chr(10) || ' ]', '[,;\n]+'), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[] "')), lambda x: x <> '') AS items
FROM (SELECT doc_id, string_split(text, ' ') AS s FROM documents)""")
def loose_lists(spark, d):
    s = F.split("text", " ")
    loose = F.concat(F.lit('["'), F.get(s, 0), F.lit('", '), F.coalesce(F.get(s, 1), F.lit("")), F.lit(";\n ]"))
    return R._docs(spark, d).select("doc_id", T.split_list(loose).alias("items"))


def _by_length(tokens: list[str]) -> np.ndarray:
    return np.eye(5)[[len(t) % 5 for t in tokens]]


@query(f"""WITH w AS (SELECT doc_id, {R._words('text')} AS w FROM documents), t AS (SELECT doc_id, u.i - 1 AS pos, w[u.i] AS token FROM w, unnest(range(1, least(len(w), 300) + 1)) u(i))
SELECT doc_id, pos::INT AS pos, token, ['O', 'B-TERM', 'I-TERM', 'B-DEF', 'I-DEF'][length(token) % 5 + 1] AS label FROM t""")
def token_labels(spark, d):
    """Classes of tokens; the limit on tokens is the operator's feature."""
    return providers.token_labels(R._docs(spark, d), _by_length, most_tokens=300)


@query(f"SELECT 'S' || s_suppkey AS node_id, [round(x, 6) FOR x IN {R._hashed(R._words('s_name'))}] AS vec FROM supplier")
def node_vectors(spark, d):
    """Nodes embedded by their label through the embedding provider."""
    nodes = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.lit("").alias("label"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"))
    return compliance.node_vectors(nodes, hashed_embedder(R.DIM), "label", "name").select("node_id", "vec")


@query(f"""WITH {R._DOC_WORDS} SELECT doc_id, (u.i - 1)::INT AS pos, c[u.i].text AS text, c[u.i].start_word::INT AS start_word, c[u.i].end_word::INT AS end_word FROM (SELECT doc_id, {R._windows(200, 50)} AS c FROM d) t, unnest(range(1, len(c) + 1)) u(i)""")
def streamed_windows(spark, d):
    """Windows of a stream of documents, all that is there, to a table of its own."""
    path = scratch(spark, "stream")
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/documents.parquet").schema).parquet(f"{d}/documents.parquet*")
    run = stateless.stream_windows(stream.select("doc_id", "text"), 200, 50).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _quarters(prompt: str) -> str | None:
    """Boundaries at every 40 characters of a text; no reply for one with an even number of them."""
    text = prompt.partition(":\n")[2]
    if len(text) % 2 == 0:
        return None
    return "here: " + json.dumps([{"start": str(k), "end": min(k + 40, len(text)), "title": f"t{k // 40}"} for k in range(0, len(text), 40)]) + " done"


@query(f"""WITH q AS (SELECT doc_id, text, length(text) % 2 = 1 AND length(text) <= 4000 AS told FROM documents),
s AS (SELECT doc_id, o, {R._strip('substring(text, o + 1, 40)')} AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 40)) AS o FROM q WHERE told) x),
m AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INT AS pos, text FROM s WHERE text <> ''),
f AS ({R._exploded(f"flatten([CASE WHEN len({R._words('s')}) > 200 THEN {R._sentences('s', '.!?;:' + chr(10))} ELSE [s] END FOR s IN {R._SEGMENTS}])", "q")})
SELECT * FROM m UNION ALL SELECT * FROM f WHERE doc_id NOT IN (SELECT doc_id FROM m)""")
def model_chunks(spark, d):
    """A boundary model's chunks; segments where it has no reply or the text is too long to ask about."""
    docs = R._docs(spark, d)
    return compliance.model_chunks(docs, _quarters, compliance.structural_chunks(docs), most_chars=4000)


def _duty(prompt: str) -> str | None:
    """Agents for one prompt, a duty for the other; no action for one agent."""
    if prompt.startswith("List"):
        return '["Data Controller", "Third Party"]'
    return json.dumps({"deontic": "must", "action": None if "Third" in prompt else "comply"})


_ASKED_SQL = "SELECT s_suppkey AS doc_id, 'The Data Controller must.' || chr(10) || chr(10) || CASE s_suppkey % 2 WHEN 0 THEN 'A Third Party shall.' ELSE 'The Third Party shall pay ' || s_name END AS text FROM supplier"


@query("""SELECT s_suppkey AS doc_id, 0 AS para_pos, 0 AS match_pos, 'Data Controller' AS agent, 'must' AS deontic, 'comply' AS action FROM supplier
UNION ALL SELECT s_suppkey, 1, 0, 'Third Party', 'shall', 'pay ' || s_name FROM supplier WHERE s_suppkey % 2 = 1""")
def asked_triples(spark, d):
    """Agents from a model, and a second prompt for paragraphs with an obligation but no action."""
    return triples.all_eventic_triples(corpus.run(spark, d, _ASKED_SQL), _duty)


def _verdict_of(prompt: str) -> str | None:
    """Fails where any rule is listed; the second provider of a chain whose first always fails."""
    return f'{verdict.FAILED} [{{"fragment":"x","reason":"y"}}]' if "- " in prompt.partition(verdict.RULES_MARK)[2].partition("\n\n")[0] else verdict.PASSED


def _unavailable(prompt: str) -> str | None:
    raise ConnectionError


@query(f"""WITH {R._EVENTIC}, no AS (SELECT agent AS id FROM ev UNION SELECT 'DEONTIC::' || deontic FROM ev UNION SELECT 'ACTION::' || action FROM ev),
nv AS MATERIALIZED (SELECT id, {R._hashed(R._words('id'))} AS vec FROM no),
c AS (SELECT doc_id * 2 AS chunk_id, doc_id, text FROM p UNION ALL SELECT doc_id * 2 + 1, doc_id, ' ' FROM p),
cv AS MATERIALIZED (SELECT chunk_id, doc_id, {R._hashed(R._words('text'))} AS vec FROM c WHERE {R._strip('text')} <> ''),
h AS (SELECT chunk_id, list_sort(list(id)) AS hits FROM cv, nv WHERE list_cosine_similarity(cv.vec, nv.vec) >= 0.5 GROUP BY 1)
SELECT chunk_id, 'doc_' || doc_id AS filename, coalesce(hits, []) AS hits, CASE WHEN hits IS NULL THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN hits IS NULL THEN 0 ELSE 1 END AS n_evidence FROM cv LEFT JOIN h USING (chunk_id)""")
def compliance_run(spark, d):
    """Embed, join, fuse, ask, parse: every chunk of the policy texts; blank ones have no row and ids keep their gaps."""
    p = R._policy(spark, d)
    chunks = p.select((F.col("doc_id") * 2).alias("chunk_id"), "doc_id", F.lit(None).cast("string").alias("filename"), "text")
    chunks = chunks.unionByName(p.select((F.col("doc_id") * 2 + 1).alias("chunk_id"), "doc_id", F.lit(None).cast("string").alias("filename"), F.lit(" ").alias("text")))
    nodes, edges = triples.eventic_graph(R._event_rows(spark, d))
    eventic = written(nodes, "eventic-nodes"), written(edges, "eventic-edges")
    out = compliance.run_compliance(chunks, eventic, R._star(spark, d), hashed_embedder(R.DIM), providers.first_reply(_unavailable, _verdict_of), 0.5, checkpoint_path=scratch(spark, "replies"))
    return out.select("chunk_id", "filename", "hits", "verdict", F.size("evidence").alias("n_evidence"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN n_nationkey % 3 = 0 THEN 'X is prohibited from sharing records' END AS fragment FROM nation")
def rule_verdicts(spark, d):
    """The rule that stands at the end of a reply chain."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    text = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "We were sharing all records of ").otherwise("We kept the records of "), "n_name")
    asked = n.select(F.col("n_nationkey").alias("k"), verdict.verdict_prompt(text, F.lit("- X is prohibited from sharing records\n- X must report")).alias("prompt"))
    told = verdict.with_verdicts(providers.with_replies(asked, providers.first_reply(_unavailable, providers.rule_reply)))
    return told.select("k", "verdict", F.get("evidence", 0)["fragment"].alias("fragment"))


_SENTENCE_WORDS = f"[{R._words('x')} FOR x IN {R._sentences('text')}]"


def _folded(step: str, first: str) -> str:
    """list_reduce over structs of one shape."""
    return f"list_reduce({first}, lambda a, x: {step})"


_PACK = _folded(
    "CASE WHEN len(a.cur) + len(x.cur) > 100 AND len(a.cur) > 0 THEN {'cur': list_concat(a.cur[greatest(len(a.cur) - 19, 1):], x.cur), 'out': list_append(a.out, array_to_string(a.cur, ' '))} ELSE {'cur': list_concat(a.cur, x.cur), 'out': a.out} END",
    "[{'cur': w, 'out': []::VARCHAR[]} FOR w IN s]",
)

R._ORACLES["packed_sentences"] = f"""WITH d AS (SELECT doc_id, {_SENTENCE_WORDS} AS s FROM documents), f AS (SELECT doc_id, {_PACK} AS r FROM d WHERE len(s) > 0),
c AS (SELECT doc_id, CASE WHEN len(r.cur) > 0 THEN list_append(r.out, array_to_string(r.cur, ' ')) ELSE r.out END AS a FROM f)
SELECT doc_id, (u.i - 1)::INT AS pos, a[u.i] AS text FROM c, unnest(range(1, len(a) + 1)) u(i)"""

_MERGE = _folded(
    f"""CASE WHEN (list_inner_product(a.mean, x.mean) >= 0.74 AND a.n + x.n <= 600) OR a.n < 60
    THEN {{'mean': [a.mean[k] + (x.mean[k] - a.mean[k]) / (a.m + 1) FOR k IN range(1, {R.DIM + 1})], 'm': a.m + 1, 'n': a.n + x.n, 'cur': a.cur || ' ' || x.cur, 'out': a.out}}
    ELSE {{'mean': x.mean, 'm': 1, 'n': x.n, 'cur': x.cur, 'out': list_append(a.out, a.cur)}} END""",
    "s",
)

R._ORACLES["semantic_chunks"] = f"""WITH e AS (SELECT doc_id, u.i AS pos, x[u.i] AS text FROM (SELECT doc_id, {R._sentences('text')} AS x FROM documents) t, unnest(range(1, len(x) + 1)) u(i)),
v AS (SELECT doc_id, pos, text, {R._hashed(R._words('text'))} AS h FROM e),
n AS (SELECT doc_id, pos, text, h, sqrt(list_sum(list_transform(h, lambda y: y * y))) AS size FROM v),
g AS (SELECT doc_id, list({{'mean': list_transform(h, lambda y: y / size), 'm': 1, 'n': len({R._words('text')}), 'cur': text, 'out': []::VARCHAR[]}} ORDER BY pos) AS s FROM n GROUP BY 1),
f AS (SELECT doc_id, {_MERGE} AS r FROM g), c AS (SELECT doc_id, list_append(r.out, r.cur) AS a FROM f)
SELECT doc_id, (u.i - 1)::INT AS pos, a[u.i] AS text FROM c, unnest(range(1, len(a) + 1)) u(i)"""


@query("SELECT 'unknown policy' AS refused, lower(hash_free) AS policy FROM (SELECT 'ODD' AS hash_free)")
def refused_policy(spark, d):
    """An unknown policy is refused before any row is read."""
    try:
        evaluation.mcc(F.lit(1), F.lit(1), F.lit(1), F.lit(1), "odd")
    except ValueError:
        return spark.read.parquet(f"{d}/region.parquet").where("r_regionkey = 0").select(F.lit("unknown policy").alias("refused"), F.lit("odd").alias("policy"))
    raise AssertionError


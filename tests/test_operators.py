"""Edge cases of single operators, with results worked out by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.functions import vectors as V
from statuta.operators import boundaries, chunking, contracts, evaluation, fusion, providers, questions, retrieval, triples, verdict
from statuta.sources import files, sinks
from statuta.sources import triples as triple_files
from statuta.streaming import stateless


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("", []), (" \t\n", []), ("a  b c\n", ["a", "b", "c"])])
def test_words(spark, text, want):
    assert one(spark, T.words, text) == want


def test_text_functions(spark):
    assert one(spark, T.normalize_text, " a co-\n  operative\n\nx ") == "a cooperative x"
    assert one(spark, T.sentences, "One. Two! three: four;five ") == ["One.", "Two!", "three:", "four;five"]
    assert one(spark, lambda c: T.sentences(c, ".!?;:\n"), "a.\n\nb") == ["a.", "b"]
    assert one(spark, T.lines, "a\r\nb\rc\n") == ["a", "b", "c", ""]
    assert [one(spark, T.is_capitals, x) for x in ("ÀB 1", "Ab", "12")] == [True, False, False]
    assert one(spark, T.proper_nouns, "The Data Controller and Oué met Ann") == ["The Data Controller", "Ann"]
    assert one(spark, T.json_array_part, 'x [1, [2]] y') == "[1, [2]]"
    assert one(spark, T.json_array_part, "] x [") is None
    assert one(spark, T.split_list, '["a", b];\n c') == ["a", "b", "c"]
    assert one(spark, T.paragraphs, "\n\n \n\n") == ["\n\n \n\n"]
    assert one(spark, T.file_stem, "/x/y.tar.gz") == "y.tar"
    assert one(spark, T.truncated, "x" * 2001).endswith("x\n\n[TRUNCATED]")


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 8, 9])
@pytest.mark.parametrize(("size", "overlap"), [(4, 1), (4, 4), (4, 9), (1, 0)])
def test_windows(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    step = size - overlap if size > overlap else max(1, size // 2)
    want = [(" ".join(words[i : i + size]), i, min(n, i + size)) for i in range(0, n, step)]
    got = spark.createDataFrame([(1, "  ".join(words))], "doc_id long, text string")
    assert [(r.text, r.start_word, r.end_word) for r in chunking.word_windows(got, size, overlap).orderBy("pos").collect()] == want
    if overlap >= size:
        with pytest.raises(ValueError):
            chunking.strict_window_array(F.col("t"), size, overlap)


def test_tail_merge(spark):
    text = " ".join("abcdefg")
    assert one(spark, lambda c: chunking.merged_tail_array(c, 4, 1, 2), text) == ["a b c d", "d e f g g"]
    assert one(spark, lambda c: chunking.merged_tail_array(c, 4, 1, 1), text) == ["a b c d", "d e f g", "g"]
    assert one(spark, lambda c: chunking.merged_tail_array(c, 9, 1, 8), text) == [text.replace("  ", " ")]


def test_segments(spark):
    text = "HEAD\nplain one\n two \n\n- bullet\n• other\n1. num\n(a) letter\n3.1 Title\nends:\n" + "X" * 120 + "\n" + "X" * 121 + "\r\nlast"
    want = ["HEAD", "plain one\ntwo", "- bullet", "• other", "1. num", "(a) letter", "3.1 Title", "ends:", "X" * 120, "X" * 121 + "\nlast"]
    assert one(spark, chunking.segment_array, text) == want
    assert one(spark, chunking.clause_array, "a\n\nb\n3.1 Title\n 4. no\n2) yes") == ["a  b", "3.1 Title", "4. no", "2) yes"]
    assert one(spark, lambda c: chunking.section_array(c, 3, 1), "top\nSection 2 a b c d\n\n\nend") == ["top", "Section 2 a", "a b c", "c d", "end"]


def test_packing_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    for _ in range(20):
        text = " ".join(" ".join(["w"] * int(n)) + "." for n in rng.integers(1, 9, 12))
        out, cur = [], []
        for s in [s for s in text.replace(".", ".\n").split("\n") if s.strip()]:
            new = s.split()
            if len(cur) + len(new) > 10 and cur:
                out.append(" ".join(cur))
                cur = cur[-3:] + new
            else:
                cur = cur + new
        assert one(spark, lambda c: chunking.packed_sentence_array(c, 10, 3), text) == [*out, " ".join(cur)]


def test_adaptive_and_overlap(spark):
    sizes = [2, 1, 12, 1, 2, 31, 1]
    rows = [(1, k, " ".join([f"c{k}"] * n)) for k, n in enumerate(sizes)]
    chunks = spark.createDataFrame(rows, "doc_id long, pos int, text string")
    got = [len(r.text.split()) for r in chunking.adaptive_size(chunks, 10, 30).orderBy("pos").collect()]
    assert got == [3, 15, 15, 17]
    got = [r.text for r in chunking.add_overlap(chunks, 2).orderBy("pos").collect()]
    assert got[1] == "c0 c0 c1" and got[2].startswith("c1 c2")


def test_boundaries(spark):
    docs = spark.createDataFrame([(1, "0123456789"), (2, "🙂ab")], "doc_id long, text string")
    reply = 'sure: [{"start":0,"end":"4","title":"t"},{"id":7,"start":2,"end":9},{"start":"x","end":3}] done'
    got = spark.createDataFrame([(reply,)], "r string").select(boundaries.parse_boundaries(F.col("r")).alias("b")).first().b
    assert [(b.id, b.start, b.end, b.title) for b in got] == [(1, 0, 4, "t"), (7, 2, 9, None)]
    rows = [(1, 0, -1, 3), (1, 1, 0, 4), (1, 2, 2, 9), (1, 3, 5, 7), (1, 4, 6, 10), (1, 5, 8, 11), (1, 6, 3, 3), (2, 0, 1, 3)]
    b = spark.createDataFrame([(d, o, s, e, f"t{o}") for d, o, s, e in rows], "doc_id long, ord int, start int, end int, title string")
    got = boundaries.boundary_slices(docs, b).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.text, r.title) for r in got] == [(1, "0123", "t1"), (1, "45678", "t2"), (1, "789", "t4"), (2, "ab", "t0")]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(V.unit(F.col("a")).alias("u"), V.unit(F.col("b")).alias("z"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.argmax(F.col("a")).alias("m")).first()
    assert (np.round(r.u, 9).tolist(), r.z, r.c, r.m) == ([0.6, 0.8], [0.0, 0.0], 0.0, 1)
    texts = ["a b a", "", "ü x"]
    native = [r.v for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(V.hashed_embedding(T.words(F.col("t")), 8).alias("v")).collect()]
    assert native == providers.hashed_embedder(8)(texts).tolist()


def test_top_k_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 1)
    chunks = spark.createDataFrame([(5, [1.0, 0.0]), (2, [2.0, 0.0]), (9, [0.0, 1.0]), (4, [0.0, 0.0])], "chunk_id long, vec array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 3.0])], "query_id long, vec array<double>")
    got = retrieval.top_k(chunks, queries, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.chunk_id) for r in got] == [(0, 1, 2), (0, 2, 5), (1, 1, 9), (1, 2, 2)]
    got = retrieval.similarity_join(chunks, queries, 1.0).collect()
    assert sorted((r.chunk_id, r.query_id) for r in got) == [(2, 0), (5, 0), (9, 1)]
    assert retrieval.top_k(chunks, queries.where("false"), 2).count() == 0


def test_eventic_edge_cases(spark):
    texts = ["The Firm must.", "he shall pay and must wait", "the bank Must Pay. The bank must pay", "no duty here", "x must " + "y" * 300, "Acme\nGroup shall\nact now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.agent, r.deontic, r.action) for r in triples.eventic_triples(docs).collect()}
    assert got == {(1, "Unknown", "shall", "pay and must wait"), (2, "Must Pay", "Must", "Pay"), (4, "Unknown", "must", "y" * 250), (5, "Acme\nGroup", "shall", "act now")}
    assert [r.doc_id for r in triples.unmatched_paragraphs(docs).collect()] == [0]


def test_graph_hops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("s", "s"), ("z", "a")], "src string, dst string")
    start = spark.createDataFrame([(1, "a"), (2, "s"), (3, "q")], "chunk_id long, node_id string")
    reach = lambda k, **o: {(r.chunk_id, r.node_id) for r in fusion.neighbours(start, edges, k, **o).collect()}
    assert reach(1) == {(1, "b"), (1, "z"), (2, "s")}
    assert reach(2) == {(1, "b"), (1, "z"), (2, "s"), (1, "c"), (1, "a")}
    assert reach(3) == reach(2) | {(1, "d")}
    assert reach(2, direction="both") == reach(3)


def test_toy_graph(spark):
    nodes, edges = triples.graph_or_toy(spark.createDataFrame([], triple_files.SCHEMA))
    assert (nodes.count(), edges.count()) == (3, 2)


def test_verdicts(spark):
    replies = [None, "", "a <Compliance Check Passed> b", 'x <Compliance Check Failed> [{"fragment":"f","reason":"r"}]', "<Compliance Check Failed> junk", "Compliance Check Passed>", "VIOLATION"]
    df = verdict.with_verdicts(spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "k int, reply string")).orderBy("k").collect()
    assert [r.verdict for r in df] == ["unknown", "unknown", "pass", "fail", "fail", "pass", "fail"]
    assert [len(r.evidence) for r in df] == [0, 0, 0, 1, 1, 1, 1]
    assert (df[3].evidence[0].fragment, df[4].evidence[0].raw, df[5].evidence[0].raw) == ("f", "junk", "Compliance Check Passed>")


def test_check_compliance(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "f", "text one"), (1, "f", " \n"), (2, "f", "two")], "chunk_id long, filename string, text string")
    fused = spark.createDataFrame([(2, ["h"], ["h"], [], "- a b c")], "chunk_id long, hits array<string>, anchors array<string>, neighbours array<string>, triples_text string")

    def failing(prompt):
        raise RuntimeError

    provider = providers.first_reply(failing, lambda p: verdict.FAILED + " []" if "- a b c" in p else None)
    got = verdict.check_compliance(chunks, fused, provider, str(tmp_path / "replies")).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.verdict) for r in got] == [(0, "unknown"), (2, "fail")]


@pytest.mark.parametrize(("pairs", "want"), [([(1, 1), (0, 0), (0, 1)], 0.5), ([(1, 1), (1, 1)], None), ([], None)])
def test_mcc(spark, pairs, want):
    df = evaluation.confusion(spark.createDataFrame(pairs, "y int, yhat int"))
    r = df.select(*[evaluation.mcc(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"), p).alias(p[:4]) for p in evaluation.POLICIES]).first()
    if want is None:
        assert (r["skle"], np.isnan(r["nan"]), r["perf"]) == (0.0, True, 1.0)
    else:
        assert all(abs(x - want) < 1e-12 for x in r)
    with pytest.raises(ValueError):
        evaluation.mcc(F.col("a"), F.col("a"), F.col("a"), F.col("a"), "other")


def test_questions(spark):
    docs = spark.createDataFrame([(1, "Is it so late?\nQ: a b\n1. two\nB. one two three\nIs it so late?\n" + "w " * 41 + "?")], "doc_id long, text string")
    assert [r.line for r in questions.question_lines(docs).collect()] == ["Is it so late?", "Q: a b", "B. one two three"]
    assert questions.queries_or_fallback(spark.createDataFrame([], "query_id long, text string")).count() == 3


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("é".encode())
    (tmp_path / "a.md").write_bytes(b"caf\xe9")
    (tmp_path / "c.pdf").write_bytes(b"1|2||3")
    (tmp_path / "d.txt").write_text(" \n")
    (tmp_path / "e.log").write_bytes(b"bad \x81")
    pages = lambda raw: raw.decode().split("|")
    got = files.read_documents(spark, str(tmp_path), pdf_pages=pages).orderBy("doc_id").collect()
    assert [(r.doc_id, r.filename, r.text) for r in got] == [(0, "a.md", "café"), (1, "b.txt", "é"), (2, "c.pdf", "1\n2\n3"), (3, "e.log", "bad ")]
    got = files.read_documents(spark, str(tmp_path), other_extensions=False).orderBy("doc_id").collect()
    assert [r.filename for r in got] == ["a.md", "b.txt"]
    assert files.join_pages(["a", "", "b"], "", False) == "ab"


def test_gold_of_bare_labels(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps([1, 0, "fail", "pass"]))
    assert [(r.chunk_id, r.label) for r in files.read_gold(spark, str(tmp_path / "gold.json")).collect()] == [(0, "fail"), (1, "pass"), (2, "fail"), (3, "pass")]


def test_static_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"s":"x","p":"y","o":"z"}]')
    (tmp_path / "b.tsv").write_text("subject\tp\to\nq\tr\ts\n")
    (tmp_path / "c.nt").write_text('<u:a> <u:b> "v w"@en .\n# note\n_:n <u:b> <u:c> .\n')
    (tmp_path / "d.ttl").write_text("no json")
    got = {(r.subject, r.predicate, r.object) for r in triple_files.read_static_folder(spark, str(tmp_path)).collect()}
    assert got == {("x", "y", "z"), ("q", "r", "s"), ("u:a", "u:b", "v w"), ("_:n", "u:b", "u:c")}
    strict = {r.subject for r in triple_files.read_static_folder(spark, str(tmp_path), strict_tsv=True).collect()}
    assert "q" not in strict


def test_contracts(spark, tmp_path):
    (tmp_path / "dev.json").write_text(json.dumps({"labels": {"n1": {"hypothesis": "h"}}, "documents": [{"file_name": "f", "text": "abcdef", "spans": [[0, 2], [4, 6]], "annotation_sets": [{"annotations": {"n1": {"choice": "Entailment", "spans": [0, 1, 5]}, "n2": {"choice": "NotMentioned", "spans": []}}}, {"annotations": {"n1": {"choice": "Contradiction", "spans": [0]}}}]}]}))
    got = contracts.flatten_contracts(files.read_contracts(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in got] == [("h", "ab ef", "compliant", "f")]
    assert files.read_contracts(spark, str(tmp_path / "none")).count() == 0


def test_token_labels(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "")], "doc_id long, text string")
    scores = lambda tokens: np.array([{"a": [0, 1, 0, 0, 0], "b": [0, 0, 1, 0, 0], "c": [1, 0, 0, 0, 0], "d": [0, 0, 0, 0, 1]}[t] for t in tokens])
    tokens = providers.token_labels(docs, scores)
    assert [r.label for r in tokens.orderBy("pos").collect()] == ["B-TERM", "I-TERM", "O", "I-DEF"]
    assert [(r.start, r.kind, r.phrase) for r in providers.label_spans(tokens).orderBy("start").collect()] == [(0, "TERM", "a b"), (3, "DEF", "d")]


def test_chunk_choice_and_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abcdef"), (2, "x y")], "doc_id long, text string")
    bounds = spark.createDataFrame([(1, 0, 0, 3, None), (2, 0, 5, 9, None)], "doc_id long, ord int, start int, end int, title string")
    chosen = chunking.choose_chunks(docs, bounds, chunking.exploded(docs, chunking.segment_array(F.col("text"))))
    numbered = chunking.with_chunk_ids(chosen)
    assert [(r.chunk_id, r.text) for r in numbered.orderBy("chunk_id").collect()] == [(0, "abc"), (1, "x y")]
    nodes, edges = triples.toy_graph(spark)
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert [x.count() for x in sinks.read_graph(spark, str(tmp_path / "g"))] == [3, 2]
    sinks.write_csv(numbered, str(tmp_path / "csv"), ["chunk_id", "text"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["chunk_id", "text"]
    sinks.write_json(numbered, str(tmp_path / "json"), "doc_id")
    sinks.write_summary(spark.createDataFrame([("a", 0.1, 1), ("b", 0.2, 1)], "experiment string, avg_score double, n long"), str(tmp_path / "s"))
    assert [json.loads(x)["experiment"] for x in next((tmp_path / "s").glob("*.json")).read_text().splitlines()] == ["b", "a"]


def test_windows_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = stateless.stream_windows(stream, 2, 1).writeStream.format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").count() == 3

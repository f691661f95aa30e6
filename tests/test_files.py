"""Readers of JSON and text files, and what follows from what they read."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.operators import chunking, evaluation, triples
from statuta.sources import files
from statuta.sources.triples import read_static_folder


def test_semantic_chunks_by_size_alone(spark):
    """Where no sentence is like another, chunks close once they have the least number of words."""
    rng = np.random.default_rng(2)
    sentences = [" ".join(["w"] * int(n)) + "." for n in rng.integers(1, 50, 60)]
    want, cur = [], []
    for s in sentences:
        if cur and sum(len(c.split()) for c in cur) >= 60:
            want.append(" ".join(cur))
            cur = []
        cur.append(s)
    want.append(" ".join(cur))
    docs = spark.createDataFrame([(0, " ".join(sentences)), (1, ""), (2, None)], "doc_id long, text string")
    distinct = lambda texts: np.eye(len(texts) + 1)[: len(texts)]
    assert [r.text for r in chunking.semantic_chunks(docs, distinct).orderBy("pos").collect()] == want
    alike = lambda texts: np.ones((len(texts), 2))
    sizes = [len(r.text.split()) for r in chunking.semantic_chunks(docs, alike, most_words=200).orderBy("pos").collect()]
    assert max(sizes) <= 200 and len(sizes) < len(want)


def test_predictions_against_gold(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"chunk_id": k, "verdict": "pass", "evidence": [{"raw": "x"}], "hits": []} for k in range(13)]))
    (tmp_path / "g.json").write_text(json.dumps([{"chunk_id": k, "label": "fail" if k in (1, 3, 4) else "pass"} for k in range(13)]))
    predictions, gold = files.read_predictions(spark, str(tmp_path / "p.json")), files.read_gold(spark, str(tmp_path / "g.json"))
    assert predictions.select(F.col("evidence")[0]["raw"].alias("x")).distinct().collect()[0].x == "x"
    for policy, want in (("sklearn", 0.0), ("perfect-if-match", 0.0), ("formula-zero-div-is-0", 0.0), ("nan", None)):
        r = evaluation.report(predictions, gold, policy).first()
        assert (r.tn, r.fp, r.fn, r.tp, r.unknown) == (10, 0, 3, 0, 0)
        assert abs(r.accuracy - 10 / 13) < 1e-12
        assert np.isnan(r.mcc) if want is None else r.mcc == want


def test_static_graph(spark, tmp_path):
    rows = [{"subject": "a", "predicate": "p", "object": "b"}, {"s": "b", "p": "q", "o": "c"}, {"sub": "d", "pred": "r", "obj": "e"}]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    nodes, edges = triples.static_graph(read_static_folder(spark, str(tmp_path)))
    assert (nodes.count(), edges.count()) == (5, 3)


def test_queries_and_chunks(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1. one\n\n  2. two \n")
    assert [tuple(r) for r in files.read_queries(spark, str(tmp_path / "q.txt")).collect()] == [(0, "1. one"), (1, "2. two")]
    (tmp_path / "c.json").write_text(json.dumps([{"doc_id": 0, "filename": "f", "text": "a", "meta": {}}, {"doc_id": 0, "filename": "f", "text": " "}], indent=2))
    assert [(r.chunk_id, r.text, r.meta) for r in files.read_chunks(spark, str(tmp_path / "c.json")).collect()] == [(0, "a", {}), (1, " ", None)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_chunks(spark, str(tmp_path / "none.json")).count()


def test_pdf_and_rdf_texts():
    import zlib

    from statuta.plans.files_registry import made_pdf
    from statuta.sources import rdf
    from statuta.sources.pdf import content_text, pdf_pages

    assert pdf_pages(made_pdf(["one é", "", "two"])) == ["one é", "", "two"]
    assert content_text(rb"BT [(a \(b\)) -20 (c)] TJ T* <64 65> Tj ET BT (f\101\n) Tj ET") == "a (b)c\nde\nfA"
    packed = b"5 0 6 40 " + b"<< /Type /Page /Contents 9 0 R >>".ljust(40) + b"<< /Type /Pages /Kids [5 0 R] >>"
    raw = b"%PDF-1.5\n8 0 obj\n<< /Type /ObjStm /First 9 /N 2 /Filter /FlateDecode >>\nstream\n" + zlib.compress(packed) + b"\nendstream\nendobj\n9 0 obj\n<< >>\nstream\nBT (x) ' ET\nendstream\nendobj"
    assert pdf_pages(raw) == ["x"]
    with pytest.raises(ValueError):
        pdf_pages(b"no pdf")
    assert rdf.turtle('@prefix e: <u:> . # note\ne:a a e:T ; e:p "v \\"w"@en, 5 .\ne:b e:q e:a, "x"^^e:t.') == [("u:a", rdf.TYPE, "u:T"), ("u:a", "u:p", 'v "w'), ("u:a", "u:p", "5"), ("u:b", "u:q", "u:a"), ("u:b", "u:q", "x")]
    assert rdf.parsed("x.ttl", "no triple") == [] and rdf.parsed("x.ttl", "") == []
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="u:"><e:T rdf:about="u:a"><e:p>v</e:p><e:q rdf:resource="u:b"/><e:r><rdf:Description rdf:about="u:c"/></e:r></e:T></rdf:RDF>'
    assert rdf.parsed("x.rdf", xml) == [("u:a", rdf.TYPE, "u:T"), ("u:a", "u:p", "v"), ("u:a", "u:q", "u:b"), ("u:a", "u:r", "u:c")]
    assert rdf.parsed("x.jsonld", '{"@context": {"p": "u:p"}, "@id": "u:a", "@type": "u:T", "p": ["v", {"@id": "u:b"}, true]}') == [("u:a", rdf.TYPE, "u:T"), ("u:a", "u:p", "v"), ("u:a", "u:p", "u:b"), ("u:a", "u:p", "true")]


def test_last_predicate_of_a_folder(spark, tmp_path):
    """A later file's predicate stays, whatever its place in the file."""
    (tmp_path / "a.json").write_text(json.dumps([{"s": "x", "p": "q", "o": "y"}, {"s": "a", "p": "FIRST", "o": "b"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"s": "a", "p": "LAST", "o": "b"}]))
    nodes, edges = triples.static_graph(read_static_folder(spark, str(tmp_path)))
    assert {(r.src, r.predicate) for r in edges.collect()} == {("x", "q"), ("a", "LAST")}
    assert [r.id for r in nodes.orderBy("seq").collect()] == ["x", "y", "a", "b"]


def test_reports(spark):
    from statuta.operators import reports

    chunks = spark.createDataFrame([(1, 0, "a b c " * 40)], "doc_id long, pos int, text string")
    assert reports.chunk_report(chunks, width=40).startswith("[1.0] 120 words\na b c")
    summary = spark.createDataFrame([("x", 0.25, 3), ("y", 0.5, 3)], "experiment string, avg_score double, n long")
    assert [line.split() for line in reports.summary_report(summary).splitlines()] == [["y", "0.5000", "3"], ["x", "0.2500", "3"]]
    labels = [(k, "fail" if k < 2 else "pass") for k in range(4)]
    report = evaluation.report(spark.createDataFrame(labels, "chunk_id long, verdict string"), spark.createDataFrame([(*x, 0) for x in labels], "chunk_id long, label string, seq long"))
    assert reports.metrics_report(report) == "pairs 4: TN 2, FP 0, FN 0, TP 2; accuracy 1.0000, MCC 1.0000; 0 unknown"


def test_chunk_ids_of_odd_documents(spark):
    rows = [(None, 0, "n"), (3, 1, "b"), (3, 0, "a"), (2**60, 0, "z"), (-5, 0, "m")]
    got = chunking.with_chunk_ids(spark.createDataFrame(rows, "doc_id long, pos int, text string")).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.text) for r in got] == [(0, "n"), (1, "m"), (2, "a"), (3, "b"), (4, "z")]

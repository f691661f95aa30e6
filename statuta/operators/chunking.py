"""Chunkers.  *_array functions map a text Column to an array Column without a
shuffle; the others map a DataFrame of (doc_id, text) to one row per chunk.

Every row result has doc_id, pos (0-based, within the document) and text, so order
never depends on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.functions import vectors as V

#: What marks a section, a bullet and a numbered clause.
SECTION = r"(?i)\n\s*(?:article|section|chapter|annex|schedule)\s+\d+\b|\n\n+"
BULLET = r"^\s*(?:[-•*]|\d+\.|\([a-zA-Z0-9]+\))\s+"
CLAUSE = r"^\d+(\.\d+)*[).]?\s+"
HEADING_CHARS = 120


def step_of(size: int, overlap: int) -> int:
    return size - overlap if size > overlap else max(1, size // 2)


def window_array(text: Column, size: int = 256, overlap: int = 16) -> Column:
    """Windows of words as structs (text, start_word, end_word); a last one may lie within its predecessor."""

    def made(w: Column) -> Column:
        n = F.size(w)
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step_of(size, overlap)))
        windows = F.transform(starts, lambda i: F.struct(T.join_words(F.slice(w, i + 1, size)).alias("text"), i.alias("start_word"), F.least(n, i + size).alias("end_word")))
        return F.filter(windows, lambda c: c["end_word"] > 0)  # a blank text has no window

    return T.let(T.words(text), made)


def strict_window_array(text: Column, size: int, overlap: int) -> Column:
    """window_array, for an overlap smaller than the window."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("the overlap must be smaller than the window, and neither negative")
    return window_array(text, size, overlap)


def merged_tail_array(text: Column, size: int, overlap: int, least_last: int = 0) -> Column:
    """Window texts; a last one of fewer than least_last words is appended to the one before."""

    def merged(made: Column) -> Column:
        n = F.size(made)
        short = (F.lit(least_last) > 0) & (n > 1) & (T.word_count(F.get(made, n - 1)) < least_last)
        joined = F.concat_ws(" ", F.get(made, n - 2), F.get(made, n - 1))
        return F.when(short, F.concat(F.slice(made, 1, F.greatest(n - 2, F.lit(0))), F.array(joined))).otherwise(made)

    return T.let(F.transform(strict_window_array(text, size, overlap), lambda c: c["text"]), merged)


def section_array(text: Column, size: int = 256, overlap: int = 16) -> Column:
    """Texts of sections (cut before a section mark or blank lines); long ones as windows."""
    parts = T.cut_at(F.regexp_replace(text, SECTION, "\u0001$0"))
    windows = F.transform(parts, lambda s: F.when(T.word_count(s) <= size, F.array(s)).otherwise(F.transform(window_array(s, size, overlap), lambda c: c["text"])))
    return F.flatten(windows)


def segment_array(text: Column) -> Column:
    """Bullets and headings by themselves, runs of other lines together, blank lines between."""
    lines = T.lines(text)

    def mark(line: Column) -> Column:
        bare = T.strip(line)
        solo = line.rlike(BULLET) | ((F.length(bare) <= HEADING_CHARS) & (T.is_capitals(bare) | bare.endswith(":")))
        return F.when(bare == "", F.lit("\u0001")).when(solo, F.concat(F.lit("\u0001"), bare, F.lit("\u0001"))).otherwise(F.concat(bare, F.lit("\n")))

    return T.cut_at(F.array_join(F.transform(lines, mark), ""))


def long_split_array(segments: Column, most_words: int = 200) -> Column:
    """Segments, those of more than most_words as their sentences."""
    pieces = F.transform(segments, lambda s: F.when(T.word_count(s) > most_words, T.sentences(s, ".!?;:\n")).otherwise(F.array(s)))
    return F.flatten(pieces)


def clause_array(text: Column) -> Column:
    """Numbered clauses by themselves; runs of other lines joined by a space."""

    def mark(line: Column) -> Column:
        bare = T.strip(line)
        return F.when(line.rlike(CLAUSE), F.concat(F.lit("\u0001"), bare, F.lit("\u0001"))).otherwise(F.concat(bare, F.lit(" ")))

    return T.cut_at(F.array_join(F.transform(T.lines(text), mark), ""))


def packed_sentence_array(text: Column, size: int, overlap: int, split: Callable[[Column], Column] = T.sentences) -> Column:
    """Whole sentences packed into chunks of about size words; each begins with the last overlap words before it.

    A chunk is a run of the text's words, so the fold carries word numbers and the words are cut out at its end.
    """
    spans = "array<struct<first:int,last:int>>"

    def add(acc: Column, n: Column) -> Column:
        first, last = acc["first"], acc["last"]
        full = (last - first + n > size) & (last > first)
        return F.struct(
            F.when(full, F.greatest(first, last - overlap)).otherwise(first).alias("first"),
            (last + n).alias("last"),
            F.when(full, F.array_append(acc["out"], F.struct(first.alias("first"), last.alias("last")))).otherwise(acc["out"]).alias("out"),
        )

    def close(acc: Column) -> Column:
        return F.when(acc["last"] > acc["first"], F.array_append(acc["out"], F.struct(acc["first"].alias("first"), acc["last"].alias("last")))).otherwise(acc["out"])

    def packed(words: Column) -> Column:
        start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"), F.array().cast(spans).alias("out"))
        made = F.aggregate(F.transform(words, F.size), start, add, close)
        return T.let(F.flatten(words), lambda w: F.transform(made, lambda c: T.join_words(F.slice(w, c["first"] + 1, c["last"] - c["first"]))))

    return T.let(F.transform(split(text), T.words), packed)


def exploded(docs: DataFrame, chunks: Column, key: str = "doc_id") -> DataFrame:
    """One row (doc_id, pos, text) for each element of an array of texts."""
    return docs.select(key, F.posexplode(chunks).alias("pos", "text"))


def word_windows(docs: DataFrame, size: int = 256, overlap: int = 16) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(window_array(F.col("text"), size, overlap)).alias("pos", "c"))
    return rows.select("doc_id", "pos", "c.text", "c.start_word", "c.end_word")


#: Documents of which a task holds the sentences at once.
SEMANTIC_DOCS = 64


def sentence_groups(vectors: np.ndarray, sizes: list[int], threshold: float = 0.74, least_words: int = 60, most_words: int = 600) -> list[list[int]]:
    """Numbers of consecutive sentences while they are near the group's mean vector, or it is short."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.where(norms == 0, 1.0, norms)
    groups, mean, size = [[0]], vectors[0], sizes[0]
    for k in range(1, len(sizes)):
        near = float(mean @ vectors[k]) >= threshold and size + sizes[k] <= most_words
        if near or size < least_words:
            groups[-1].append(k)
            mean, size = mean + (vectors[k] - mean) / len(groups[-1]), size + sizes[k]
        else:
            groups.append([k])
            mean, size = vectors[k], sizes[k]
    return groups


def semantic_chunks(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], threshold: float = 0.74, least_words: int = 60, most_words: int = 600) -> DataFrame:
    """Consecutive sentences while they are near the chunk's mean vector, or it is short.

    The mean of unit vectors is not made a unit again.  A sequential fold, one
    document at a time in Arrow batches; embed maps sentences to vectors.
    """

    def fold(sentences: list[str]) -> list[str]:
        groups = sentence_groups(np.asarray(embed(sentences), float), [len(s.split()) for s in sentences], threshold, least_words, most_words)
        return [" ".join(sentences[k] for k in g) for g in groups]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SEMANTIC_DOCS):
                part = batch.slice(at, SEMANTIC_DOCS)
                made = [fold(s) if s else [] for s in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.string()))], names=["doc_id", "chunks"])

    folded = docs.select("doc_id", T.sentences(F.coalesce("text", F.lit(""))).alias("s")).mapInArrow(task, "doc_id long, chunks array<string>")
    return exploded(folded, F.col("chunks"))


def _by(key: str) -> Window:
    return Window.partitionBy(key).orderBy("pos")


def semantic_refine(chunks: DataFrame, threshold: float = 0.85, key: str = "doc_id") -> DataFrame:
    """Adjacent chunks (key, pos, text, vec) joined where the cosine of their own vectors is above threshold."""
    before = F.lag("vec").over(_by(key))
    joins = F.coalesce(V.cosine(F.col("vec"), before) > threshold, F.lit(False))
    marked = chunks.withColumn("starts", F.when(joins, 0).otherwise(1))
    grouped = marked.withColumn("pos2", F.sum("starts").over(_by(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    return grouped.groupBy(key, F.col("pos2").cast("int").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), "text"))), lambda c: c["text"]), " ").alias("text"))


def adaptive_size(chunks: DataFrame, least: int = 100, most: int = 600, key: str = "doc_id") -> DataFrame:
    """Chunks of fewer than least words join the one before; those above most are halved once."""
    counted = chunks.withColumn("w", T.words(F.col("text"))).withColumn("n", F.size("w"))
    starts = F.when((F.col("n") >= least) | (F.row_number().over(_by(key)) == 1), 1).otherwise(0)
    grouped = counted.withColumn("starts", starts).withColumn("island", F.sum("starts").over(_by(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    members = grouped.groupBy(key, "island").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "n", "w"))).alias("m"))
    head = F.col("m")[0]
    half = F.floor(head["n"] / 2).cast("int")
    halves = F.array(T.join_words(F.slice(head["w"], 1, half)), T.join_words(F.slice(head["w"], half + 1, head["n"])))
    pieces = F.when(head["n"] > most, halves).otherwise(F.array(head["text"]))
    rest = F.transform(F.slice("m", 2, F.greatest(F.size("m"), F.lit(1))), lambda c: c["text"])
    last = F.array_join(F.concat(F.slice("pieces", -1, 1), rest), " ")
    made = members.withColumn("pieces", pieces).select(key, "island", F.posexplode(F.concat(F.slice("pieces", 1, F.size("pieces") - 1), F.array(last))).alias("part", "text"))
    return made.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("island", "part")) - 1).alias("pos"), "text")


def add_overlap(chunks: DataFrame, stride: int = 50, key: str = "doc_id") -> DataFrame:
    """Each chunk after the last stride words of the one before."""
    w = T.words(F.col("text"))
    before = F.lag(w).over(_by(key))
    tail = F.slice(before, F.greatest(F.lit(-stride), -F.size(before)), stride)
    return chunks.select(key, "pos", T.join_words(F.when(before.isNull() | (F.size(before) == 0), w).otherwise(F.concat(tail, w))).alias("text"))


def hybrid_chunks(docs: DataFrame, embed: Callable[[Column], Column], threshold: float = 0.85, least: int = 100, most: int = 600, stride: int = 50) -> DataFrame:
    """Numbered clauses, refined by similarity, sized, and overlapped; embed maps a text Column to a vector."""
    clauses = exploded(docs, clause_array(F.col("text"))).withColumn("vec", embed(F.col("text")))
    return add_overlap(adaptive_size(semantic_refine(clauses, threshold), least, most), stride)


def choose_chunks(docs: DataFrame, boundaries: DataFrame, fallback: DataFrame) -> DataFrame:
    """Slices of documents that have valid boundaries; rows of fallback for all others."""
    from statuta.operators.boundaries import boundary_slices

    sliced = boundary_slices(docs, boundaries).select("doc_id", "pos", "text")
    return sliced.unionByName(fallback.select("doc_id", "pos", "text").join(sliced.select("doc_id").distinct(), "doc_id", "left_anti"))


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id numbers all chunks in document order.

    Documents are counted first and only their counts are put in order, in blocks
    of 10,000 ids, so that no task holds all documents.  Chunks of a null id come first.
    """
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.first(F.expr("doc_id div 10000")).alias("block"))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("block_n"))
    ahead = F.coalesce(F.sum("block_n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select(F.col("block").alias("of_block"), ahead.alias("ahead"))
    first = counts.join(placed, F.col("block").eqNullSafe(F.col("of_block"))).select(F.col("doc_id").alias("of_doc"), (F.col("ahead") + inside).alias("first"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return chunks.join(first, F.col("doc_id").eqNullSafe(F.col("of_doc"))).withColumn("chunk_id", F.col("first") + place).drop("first", "of_doc")

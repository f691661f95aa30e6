"""Documents from folders of files.

Files are read with Spark's binaryFile source; text is decoded by an Arrow
function and PDF text comes from a pluggable provider.  Folder names, blank texts
and (if asked) other extensions are dropped; doc_id is the place among the files
that stay, in order of their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.sources import pdf
from statuta.sources.scratch import written

#: Extensions that are read as text.
TEXT_EXTENSIONS = ["txt", "md", "text"]
Pages = Callable[[bytes], list[str]]


def decode_text(raw: bytes, fallback: bool = True) -> str:
    """UTF-8; else cp1252; else UTF-8 without the bytes that are none."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    if fallback:
        try:
            return raw.decode("cp1252")
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "ignore")


def join_pages(pages: list[str], joiner: str = "\n", drop_empty: bool = True) -> str:
    return joiner.join(p for p in pages if p or not drop_empty)


def file_texts(files: DataFrame, pdf_pages: Pages = pdf.pdf_pages, joiner: str = "\n", drop_empty: bool = True, fallback: bool = True) -> DataFrame:
    """filename, text of binaryFile rows; a PDF that can't be read has an empty text.  pdf_pages maps its bytes to pages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ext, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if ext != "pdf":
                    texts.append(decode_text(raw.as_py(), fallback))
                    continue
                try:
                    texts.append(join_pages(pdf_pages(raw.as_py()), joiner, drop_empty))
                except Exception:
                    texts.append("")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["filename", "text"])

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(name.alias("filename"), T.file_extension(F.col("path")).alias("ext"), "content").mapInArrow(task, "filename string, text string")


def read_documents(spark: SparkSession, folder: str, other_extensions: bool = True, **options) -> DataFrame:
    """doc_id, filename, text of the files of a folder (not of its folders)."""
    files = spark.read.format("binaryFile").load(folder)
    if not other_extensions:
        files = files.where(T.file_extension(F.col("path")).isin([*TEXT_EXTENSIONS, "pdf"]))
    texts = written(file_texts(files, **options).where(T.strip(F.col("text")) != ""), "file-texts")  # read and decoded once
    names = texts.select("filename").withColumn("doc_id", F.row_number().over(Window.orderBy("filename")).cast("long") - 1)  # names only
    return texts.join(names, "filename").select("doc_id", "filename", "text")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text: the non-blank lines of a file, stripped, in order."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(T.lines(F.col("value"))).alias("pos", "raw")).select("pos", T.strip(F.col("raw")).alias("text"))
    return rows.where("text <> ''").select((F.row_number().over(Window.orderBy("pos")) - 1).cast("long").alias("query_id"), "text")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, doc_id, filename, text of a JSON array of chunks; chunk_id is the place in the array."""
    return json_array(spark, path, "doc_id long, filename string, text string, meta map<string,string>", "chunk_id")


def json_array(spark: SparkSession, path: str, item: str, ordinal: str) -> DataFrame:
    """The items of one JSON array file, with their places."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<struct<{_typed(item)}>>")).alias(ordinal, "x")).select(F.col(ordinal).cast("long"), "x.*")


def _typed(item: str) -> str:
    return ",".join(":".join(x.split(None, 1)) for x in _fields(item))


def _fields(item: str) -> list[str]:
    out, depth, last = [], 0, 0
    for k, c in enumerate(item):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(item[last:k].strip())
            last = k + 1
    return [*out, item[last:].strip()]


PREDICTION = "chunk_id long, filename string, hits array<string>, P array<string>, N array<string>, verdict string, evidence array<struct<fragment:string,reason:string,raw:string>>, llm_reply string, triples_text string"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, PREDICTION, "seq")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, label, seq of an array of {chunk_id, label} or of bare labels, whose place is their id."""
    items = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("seq", "item"))
    bare = ~F.col("item").startswith("{")
    chunk = F.when(bare, F.col("seq").cast("long")).otherwise(F.get_json_object("item", "$.chunk_id").cast("long"))
    return items.select(chunk.alias("chunk_id"), label_text(F.when(bare, F.col("item")).otherwise(F.get_json_object("item", "$.label"))).alias("label"), F.col("seq").cast("long"))


def label_text(label: Column) -> Column:
    """A number as the label that it stands for: 1 fail, 0 pass."""
    return F.when(label == "1", "fail").when(label == "0", "pass").otherwise(label)


CORPUS = "labels map<string,struct<hypothesis:string>>, documents array<struct<file_name:string,text:string,spans:array<array<int>>,annotation_sets:array<struct<annotations:map<string,struct<choice:string,spans:array<int>>>>>>>"


def read_contracts(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """The corpora of the splits that exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    paths = [f"{folder}/{s}.json" for s in splits]
    found = [p for p in paths if (h := hadoop.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(h)]
    return spark.read.schema(CORPUS).json(found, multiLine=True) if found else spark.createDataFrame([], CORPUS)

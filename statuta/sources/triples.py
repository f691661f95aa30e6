"""Triples from JSON, CSV, TSV, N-Triples and other RDF files: subject, predicate, object, source_file, seq."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.sources.rdf import triples_from_rdf

SCHEMA = "subject string, predicate string, object string, source_file string, seq long"
#: Names of the parts of a triple, and predicates of shorthand forms.
SUBJECT, PREDICATE, OBJECT = ["subject", "s", "sub"], ["predicate", "p", "pred"], ["object", "o", "obj"]
RELATED, HAS_VALUE = "relatedTo", "hasValue"


def triples_from_json(texts: DataFrame) -> DataFrame:
    """Triples of rows (source_file, value) of JSON text.

    A list holds objects with the parts under any of their names, kept where all
    three are there; an object holds {s: {p: [o] or o}}, {s: [o]} (related) or
    {s: value} (has value).  Text that is no JSON gives nothing.
    """
    v = texts.select("source_file", F.try_parse_json("value").alias("v")).where("v is not null")
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    parts = lambda names: T.falsy_coalesce(*[F.try_variant_get("item", f"$.{n}", "string") for n in names])
    spark = texts.sparkSession
    names = [f"triples_{uuid4().hex}_{k}" for k in range(3)]  # views of this call alone, gone when it ends
    v.createOrReplaceTempView(names[0])
    items = spark.sql(f"select source_file, pos, value as item from {names[0]}, lateral variant_explode(v) where schema_of_variant(v) like 'ARRAY%'")
    listed = items.select("source_file", F.col("pos").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), parts(SUBJECT).alias("subject"), parts(PREDICATE).alias("predicate"), parts(OBJECT).alias("object"))
    spark.sql(f"select source_file, pos as a, key as subject, value as inner_value from {names[0]}, lateral variant_explode(v) where schema_of_variant(v) like 'OBJECT%'").createOrReplaceTempView(names[1])
    kind = "schema_of_variant(inner_value)"
    scalar = spark.sql(f"select source_file, a, 0 as b, 0 as c, subject, '{HAS_VALUE}' as predicate, cast(inner_value as string) as object from {names[1]} where {kind} not like 'ARRAY%' and {kind} not like 'OBJECT%'")
    related = spark.sql(f"select source_file, a, pos as b, 0 as c, subject, '{RELATED}' as predicate, cast(value as string) as object from {names[1]}, lateral variant_explode(inner_value) where {kind} like 'ARRAY%'")
    spark.sql(f"select source_file, a, pos as b, subject, key as predicate, value as o from {names[1]}, lateral variant_explode(inner_value) where {kind} like 'OBJECT%'").createOrReplaceTempView(names[2])
    many = spark.sql(f"select source_file, a, b, pos as c, subject, predicate, cast(value as string) as object from {names[2]}, lateral variant_explode(o) where schema_of_variant(o) like 'ARRAY%'")
    one = spark.sql(f"select source_file, a, b, 0 as c, subject, predicate, cast(o as string) as object from {names[2]} where schema_of_variant(o) not like 'ARRAY%'")
    for name in names:
        spark.catalog.dropTempView(name)
    rows = reduce(DataFrame.unionByName, [listed, scalar, related, many, one])
    return _numbered(rows.where("subject is not null and predicate is not null and object is not null"), ["a", "b", "c"])


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """seq numbers the triples of each file in order."""
    place = F.row_number().over(Window.partitionBy("source_file").orderBy(*order)).cast("long") - 1
    return rows.withColumn("seq", place).select("subject", "predicate", "object", "source_file", "seq")


def triples_from_rows(rows: DataFrame, width: Column) -> DataFrame:
    """Triples of rows (source_file, line, a, b, c): blank subjects and short rows dropped, a blank predicate related."""
    bare = rows.where(width >= 3).select("source_file", "line", *[T.strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("a", "b", "c")])
    first = F.row_number().over(Window.partitionBy("source_file").orderBy("line")) == 1
    headless = bare.withColumn("head", first & F.lower("a").contains("subject")).where("not head and a <> ''")
    named = headless.select("source_file", "line", F.col("a").alias("subject"), F.coalesce(F.nullif("b", F.lit("")), F.lit(RELATED)).alias("predicate"), F.col("c").alias("object"))
    return _numbered(named, ["line"])


def triples_from_delimited(texts: DataFrame, sep: str = ",") -> DataFrame:
    """Triples of rows (source_file, value) of delimited text, one record a line."""
    lines = texts.select("source_file", F.posexplode(T.lines(F.col("value"))).alias("line", "raw")).where("raw <> ''")
    fields = F.from_csv("raw", F.lit("a string, b string, c string"), {"sep": sep, "mode": "PERMISSIVE"})
    quoted = F.regexp_replace("raw", '"([^"]|"")*"', "q")
    return triples_from_rows(lines.select("source_file", "line", "raw", fields.alias("f"), quoted.alias("q")).select("source_file", "line", "q", "f.a", "f.b", "f.c"), F.size(F.split("q", "\\" + sep if sep in ".|\\" else sep)))


N_TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*")(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?\s*\.\s*(#.*)?$'


def triples_from_nt(texts: DataFrame) -> DataFrame:
    """Triples of rows (source_file, value) of N-Triples; other lines are skipped."""
    lines = texts.select("source_file", F.posexplode(T.lines(F.col("value"))).alias("line", "raw")).where(F.col("raw").rlike(N_TRIPLE))
    bare = lambda k: F.regexp_replace(F.regexp_extract("raw", N_TRIPLE, k), r'^[<"]|[>"]$', "")
    return _numbered(lines.select("source_file", "line", bare(1).alias("subject"), F.regexp_extract("raw", N_TRIPLE, 2).alias("predicate"), bare(3).alias("object")), ["line"])


def read_static_folder(spark: SparkSession, folder: str, strict_tsv: bool = False, rdf: Callable[[DataFrame], DataFrame] = triples_from_rdf) -> DataFrame:
    """All triples of a folder's files, by extension; files that can't be read give none.

    strict_tsv reads .tsv with commas.  rdf reads .rdf, .ttl, .owl, .xml and .jsonld
    texts.  seq follows the files' names, then the places in them.
    """
    texts = spark.read.option("ignoreCorruptFiles", True).text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))
    ext = T.file_extension(F.col("source_file"))
    of = lambda *names: texts.where(ext.isin(*names))
    parts = [triples_from_json(of("json")), triples_from_delimited(of("csv")), triples_from_delimited(of("tsv"), "," if strict_tsv else "\t"), triples_from_nt(of("nt")), rdf(of("rdf", "ttl", "owl", "xml", "jsonld"))]
    return ordered(reduce(DataFrame.unionByName, parts))


def ordered(triples: DataFrame) -> DataFrame:
    """seq over all files: by file, then place in it (up to 2**32 in each)."""
    names = triples.select("source_file").distinct()
    numbered = names.select(F.col("source_file").alias("of"), F.row_number().over(Window.orderBy("source_file")).cast("long").alias("file"))  # names only
    joined = triples.join(numbered, triples.source_file == numbered.of)
    return joined.select("subject", "predicate", "object", "source_file", (F.shiftleft("file", 32) + F.col("seq")).alias("seq"))

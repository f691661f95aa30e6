"""Boundaries that a model proposes: parsing, validation, slicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.operators.verdict import boundaries_prompt  # noqa: F401

#: A model is not asked about longer texts.
MODEL_CHARS = 40_000
ITEMS = "array<struct<id:string,start:string,end:string,title:string>>"


def parse_boundaries(reply: Column) -> Column:
    """array<struct<id, start, end, title>> of a reply; null if it holds no array.

    An item without an id is numbered by its place; one whose bounds are no
    integers is dropped.
    """
    items = F.from_json(T.json_array_part(reply), ITEMS)
    typed = F.transform(items, lambda x, i: F.struct(
        F.coalesce(x["id"].try_cast("int"), i + 1).alias("id"),
        x["start"].try_cast("int").alias("start"), x["end"].try_cast("int").alias("end"), x["title"].alias("title")))
    return F.filter(typed, lambda x: x["start"].isNotNull() & x["end"].isNotNull())


def valid_boundaries(docs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Rows (doc_id, ord, start, end, title) that lie within the text, each from the end of the one before at least.

    That end may be before the end of an earlier one, so overlaps of nested
    boundaries stay.
    """
    sized = boundaries.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    inside = sized.where((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("n")))
    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("start", "ord"))
    return inside.withColumn("start", F.greatest("start", F.coalesce(before, F.lit(0)))).drop("n")


def boundary_slices(docs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """doc_id, pos, text, title of the non-blank slices of valid boundaries."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "ord")) - 1
    cut = valid_boundaries(docs, boundaries).join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id")
    cut = cut.withColumn("text", T.strip(F.expr("substring(whole, start + 1, greatest(end - start, 0))"))).where("text <> ''")
    return cut.withColumn("pos", place).select("doc_id", "pos", "text", "title")

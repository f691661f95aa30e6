"""Contract corpora: nested documents with annotated spans, as pairs of clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions import text as T

#: What a choice of the annotators means.
CHOICES = {"Entailment": "compliant", "Contradiction": "noncompliant", "NotMentioned": "uncertain"}


def flatten_contracts(corpora: DataFrame) -> DataFrame:
    """reference_clause, target_clause, compliance, source_file of each annotation of the first set that has evidence.

    corpora has labels (map of id to hypothesis) and documents.  A hypothesis
    that is not listed is its id; a choice that is not known gives null; span
    numbers out of range are skipped.
    """
    docs = corpora.select("labels", F.explode("documents").alias("d"))
    notes = docs.select("labels", "d", F.explode(F.get(F.col("d.annotation_sets"), 0)["annotations"]).alias("hypothesis", "note"))
    spans = F.col("d.spans")
    inside = F.filter("note.spans", lambda i: (i >= 0) & (i < F.size(spans)))
    piece = lambda i: F.substring(F.col("d.text"), F.get(F.get(spans, i), 0) + 1, F.greatest(F.get(F.get(spans, i), 1) - F.get(F.get(spans, i), 0), F.lit(0)))
    target = T.strip(F.array_join(F.transform(inside, piece), " "))
    known = F.create_map(*[F.lit(x) for pair in CHOICES.items() for x in pair])
    return notes.select(
        F.coalesce(F.try_element_at("labels", F.col("hypothesis"))["hypothesis"], F.col("hypothesis")).alias("reference_clause"),
        target.alias("target_clause"),
        F.try_element_at(known, F.col("note.choice")).alias("compliance"),
        F.col("d.file_name").alias("source_file"),
    ).where("target_clause <> ''")

"""Predictions against gold labels, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The policies for labels of one class.
POLICIES = ("sklearn", "nan", "perfect-if-match", "formula-zero-div-is-0")


def to_binary(label: Column) -> Column:
    """1 for fail in any case, a whole number as it is, 0 for any other label (unknown and null count as pass)."""
    number = F.when(F.trim(label).rlike(r"^[+-]?\d+$"), F.trim(label).try_cast("int"))
    return F.coalesce(number, (F.lower(label) == "fail").cast("int"), F.lit(0))


def paired(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """chunk_id, y, yhat of predictions (chunk_id, verdict) that have a gold label (chunk_id, label, seq).

    Of gold rows with one id the last counts; of predictions all do.
    """
    last = gold.groupBy("chunk_id").agg(F.max_by("label", "seq").alias("label"))
    return predictions.join(last, "chunk_id").select("chunk_id", to_binary(F.col("label")).alias("y"), to_binary(F.col("verdict")).alias("yhat"))


def confusion(pairs: DataFrame) -> DataFrame:
    """n, tn, fp, fn, tp and whether all labels and predictions agree."""
    cell = lambda y, p: F.count_if((F.col("y") == y) & (F.col("yhat") == p))
    return pairs.agg(F.count("*").alias("n"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def accuracy(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    return F.try_divide((tn + tp).cast("double"), (tn + fp + fn + tp).cast("double"))


def mcc(tn: Column, fp: Column, fn: Column, tp: Column, policy: str = "sklearn") -> Column:
    """Matthews correlation; policy says what holds where labels or predictions are of one class."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
    tn, fp, fn, tp = (c.cast("double") for c in (tn, fp, fn, tp))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    full = F.coalesce(F.try_divide(tp * tn - fp * fn, root), F.lit(0.0))
    single = (tp + fn == 0) | (tn + fp == 0) | (tp + fp == 0) | (tn + fn == 0)
    if policy == "nan":
        return F.when(single, F.lit(float("nan"))).otherwise(full)
    if policy == "perfect-if-match":
        return F.when(single, F.when(fp + fn == 0, F.lit(1.0)).otherwise(0.0)).otherwise(full)
    return full


def report(predictions: DataFrame, gold: DataFrame, policy: str = "sklearn") -> DataFrame:
    """n, tn, fp, fn, tp, accuracy, mcc, and how many verdicts were unknown."""
    unknown = predictions.agg(F.count_if(F.col("verdict") == "unknown").alias("unknown"))
    counts = confusion(paired(predictions, gold))
    cells = [F.col(c) for c in ("tn", "fp", "fn", "tp")]
    return counts.withColumns({"accuracy": accuracy(*cells), "mcc": mcc(*cells, policy)}).crossJoin(unknown)

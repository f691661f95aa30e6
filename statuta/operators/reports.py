"""Reports as text, for a console or a log: small tables only, by a stated number of rows."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame


def wrapped(text: str, width: int = 100) -> str:
    return textwrap.fill(text, width)


def chunk_report(chunks: DataFrame, most: int = 20, width: int = 100) -> str:
    """The first chunks by document and place, wrapped."""
    rows = chunks.orderBy("doc_id", "pos").limit(most).collect()
    return "\n\n".join(f"[{r.doc_id}.{r.pos}] {len(r.text.split())} words\n{wrapped(r.text, width)}" for r in rows)


def summary_report(summary: DataFrame, most: int = 100) -> str:
    """A line for each experiment, the best first."""
    rows = summary.orderBy(summary.avg_score.desc(), "experiment").limit(most).collect()
    return "\n".join(f"{r.experiment:<24}{r.avg_score:>8.4f}{r.n:>8}" for r in rows)


def metrics_report(report: DataFrame) -> str:
    """The one row of an evaluation."""
    r = report.first()
    return f"pairs {r.n}: TN {r.tn}, FP {r.fp}, FN {r.fn}, TP {r.tp}; accuracy {r.accuracy:.4f}, MCC {r.mcc:.4f}; {r.unknown} unknown"

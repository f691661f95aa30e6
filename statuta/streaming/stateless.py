"""Stateless stages over streams: the Column chunkers run unchanged on readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from statuta.operators.chunking import word_windows
from statuta.operators.verdict import with_verdicts

__all__ = ["stream_windows", "stream_verdicts"]


def stream_windows(docs: DataFrame, size: int = 256, overlap: int = 16) -> DataFrame:
    """word_windows of a stream of (doc_id, text)."""
    return word_windows(docs, size, overlap)


def stream_verdicts(replies: DataFrame) -> DataFrame:
    """with_verdicts of a stream of (chunk_id, reply)."""
    return with_verdicts(replies)

"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: words in lower case without outer
punctuation, numbers as <NUM>, units after a number as <UNIT>, and capitalised
words inside a sentence (but not those all in capitals) as <NAME>.  Since names
are told by case, a second view of the text keeps names as words; letters of all
scripts are folded in both, so case alone hides no copy.  A third view has the
words as they are, numbers and units too; there only windows are searched that
have too few literal tokens for the second (LITERALS), and those of items of
fewer than MIN_TOKENS tokens, so exact copies of them are found.  Windows of WINDOW
template tokens of the documents are, in each view, hash-joined with those of the benchmark items (an item shorter
than that is one window).  Matches of a view are lined up by their distance (position in
the document less position in the item); in each line the values of the slots
must agree: one item value stands for one document value throughout.  So an
item with other numbers or names is still found, and chance matches that fill
the slots at random are not.  An item is found when its windows matched in
the first or second view, or in all views together, are COVERAGE of those it has there.

The map side keeps only windows that occur in the benchmark when its distinct
windows number at most FILTER_WINDOWS (counted first); beyond that every window
goes to the join, which gives the same rows.

Defined results: a null or blank text or item matches nothing; items of fewer
than MIN_TOKENS template tokens are matched word for word only; rows that repeat an id with
other texts, or have none, are documents of their own, rows that repeat id and text are one; an
empty table on either side gives an empty result.  Extra columns are ignored by the search and
kept by drop_contaminated(), which drops rows by their own text.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.store import arrow_rows, materialise, row_key, table, without
from statuta.llm.textkit import LOWER, SPACE, U, hash_word, mix, text_slices, word_bounds, word_hashes

WINDOW = 8
MIN_TOKENS = 4
#: Share of an item's windows that must match in consistent lines.
COVERAGE = 0.3
#: Tokens of a window that must not be slots.
LITERALS = 4
FILTER_WINDOWS = 2_000_000
#: Texts that are sent to a worker at once.
BATCH_ROWS = 500
UNITS = tuple("mm cm m km kg g mg lb lbs oz ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years ft foot feet inch inches mile miles mph kmh kph percent dollar dollars euro euros cent cents usd eur gbp degrees celsius fahrenheit watts volts mb gb tb".split())
_NUM, _UNIT, _NAME = (hash_word(x) for x in (b"<NUM>", b"<UNIT>", b"<NAME>"))
_UNIT_HASHES = np.sort(np.array([hash_word(u.encode()) for u in UNITS], dtype=U))
_MARK = np.zeros(256, dtype=bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:;"]] = True
_STEP = U(0x9FB21C651E98DF25)


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a slice without case; no letter's other case is, or has, a space or an ASCII mark."""
    if not (data > 127).any():
        return LOWER[data], offsets
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    texts = [x.lower() if x.isascii() else x.decode("utf-8", "replace").upper().casefold().encode() for x in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def cores(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, end with outer marks) of each word, without outer marks; empty if it has no more."""
    raw_start, raw_end, row = word_bounds(data, offsets)
    n = len(data)
    core = ~(SPACE[data] | _MARK[data])
    at = np.arange(n)
    after = np.minimum.accumulate(np.where(core, at, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(core, at, -1))
    return after[raw_start], before[raw_end - 1] + 1, row, raw_end


class Template(NamedTuple):
    """The template tokens of the texts of a slice: their rows, hashes as words, and which are slots of a kind."""

    row: np.ndarray
    words: np.ndarray
    number: np.ndarray
    name: np.ndarray
    unit: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def view(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, slot flag) of each token; names are slots in view 0 and words in view 1; view 2 has no slots."""
        if k == 2:
            return self.words, np.zeros(len(self.words), bool)
        h, slot = self.words.copy(), self.number | self.unit
        h[self.number], h[self.unit] = U(_NUM), U(_UNIT)
        if k == 0:
            h[self.name] = U(_NAME)
            slot = slot | self.name
        return h, slot

    def value(self, t: int) -> str:
        return self.data[self.start[t] : self.end[t]].tobytes().decode("utf-8", "replace")


def template(data: np.ndarray, offsets: np.ndarray) -> Template:
    """The template tokens of the texts of a slice, in order."""
    start, end, row, raw_end = cores(data, offsets) if len(data) else [np.zeros(0, np.int64)] * 4
    n = len(data)
    kept = start < end
    if not kept.any():
        none = np.zeros(0, np.int64)
        return Template(none, np.zeros(0, U), *[np.zeros(0, bool)] * 3, data, none, none)
    plain, plain_offsets = folded(data, offsets)
    plain_start, plain_end, _, _ = cores(plain, plain_offsets)
    plain_start, plain_end = plain_start[kept], plain_end[kept]
    prev_end = np.concatenate([[0], raw_end[:-1]])
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.concatenate([[True], row[1:] != row[:-1]]) | _STOP[data[np.maximum(prev_end - 1, 0)]]
    start, end, row, opens, prev_end = start[kept], end[kept], row[kept], opens[kept], prev_end[kept]
    opens |= lines[start] > lines[prev_end]
    h = word_hashes(plain, plain_start, plain_end)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = digits[end] > digits[start]
    first = data[start]
    second = data[np.minimum(start + 1, n - 1)]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    follows = np.where(first == 0xC3, np.minimum(start + 2, n - 1), np.minimum(start + 1, n - 1))
    shouted = ((data[follows] >= 65) & (data[follows] <= 90)) | (follows >= end)  # a text in capitals has no names to tell
    name = capital & ~shouted & ~opens & ~number
    after_number = np.concatenate([[False], number[:-1] & (row[1:] == row[:-1])])
    known = _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, h), len(_UNIT_HASHES) - 1)] == h
    unit = after_number & known & ~number
    return Template(row, h, number, name & ~unit, unit, plain, plain_start, plain_end)


def windows(h: np.ndarray, slot: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first token) of each window with enough literal tokens."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    out = np.full(n, width, dtype=U)
    for j in range(width):
        out = out * _STEP + h[j : n + j]
    slots = np.concatenate([[0], np.cumsum(slot)])
    ok = (row[:n] == row[width - 1 :]) & (width - (slots[width:] - slots[:-width]) >= min(LITERALS, width - 1))
    first = np.flatnonzero(ok)
    return mix(out[ok]), first


VIEWS = (0, 1, 2)
WINDOWS = "id long, doc long, position long, view int, width int, tokens long, key long, slots array<string>"


def template_windows(texts: DataFrame, searched: list[tuple[int, int]] | None = None, known: np.ndarray | None = None) -> DataFrame:
    """Windows of texts (id, doc, text) in the views and widths to search; without these, those by which items are searched."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs = batch.column(0), batch.column(1)
            for at, rows, data, offsets in text_slices(batch.column(2)):
                made = template(data, offsets)
                row = made.row
                counts = np.bincount(row, minlength=rows)
                firsts = np.cumsum(counts) - counts
                views = {k: made.view(k) for k in VIEWS}
                for view, width in searched or itertools.product(VIEWS, range(1, WINDOW + 1)):
                    if view < 2 and width < MIN_TOKENS:
                        continue
                    h, slot = views[view]
                    key, first = windows(h, slot, row, width)
                    key = mix(key ^ U(view))
                    if searched is None:  # an item's own width is its length, WINDOW at most
                        own = np.minimum(counts[row[first]], WINDOW) == width
                        key, first = key[own], first[own]
                        if view == 2 and width >= MIN_TOKENS:  # the documents' windows of this view are not told apart
                            poor = ~np.isin(first, windows(*views[1], row, width)[1])
                            key, first = key[poor], first[poor]
                    if known is not None and len(key):
                        hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)
                        key, first = key[hit], first[hit]
                    if not len(key):
                        continue
                    slots = [[made.value(t) for t in range(f, f + width) if slot[t]] for f in first.tolist()]
                    yield pa.RecordBatch.from_pydict({
                        "id": ids.take(pa.array(at + row[first])),
                        "doc": docs.take(pa.array(at + row[first])),
                        "position": pa.array(first - firsts[row[first]], pa.int64()),
                        "view": pa.array(np.full(len(first), view), pa.int32()),
                        "width": pa.array(np.full(len(first), width), pa.int32()),
                        "tokens": pa.array(counts[row[first]], pa.int64()),
                        "key": pa.array(key.view(np.int64)),
                        "slots": pa.array(slots, pa.list_(pa.string())),
                    })

    return texts.mapInArrow(task, WINDOWS)


def found_in_rows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, coverage: float, filter_windows: int) -> DataFrame:
    """key (of id and text), doc_id, item_id, matched and total windows, and whether slot values are the item's own."""
    item = F.col(item_col).cast("long")
    bench = materialise(template_windows(items.select(item.alias("id"), item.alias("doc"), F.col(item_text).alias("text"))), "bench-windows").drop("doc")
    searched = sorted((r.view, r.width) for r in bench.select("view", "width").distinct().collect())
    known = None
    if bench.count() <= filter_windows:
        known = np.unique(bench.select("key").toArrow()["key"].to_numpy().view(U))  # filter_windows of 8 bytes at most
    texts = docs.select(row_key(docs, id_col, text_col).alias("id"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    found = template_windows(texts, searched or [(0, WINDOW)], known)
    totals = bench.groupBy("id").agg(F.count_distinct("position").alias("item_windows"), *_of_views(lambda k: F.count_distinct(F.when(F.col("view") == k, F.col("position"))), "total"))
    items_side = bench.select(F.col("id").alias("item_id"), F.col("position").alias("item_position"), "view", F.col("key").alias("window"), F.col("slots").alias("item_slots"))
    pairs = found.drop("view").join(items_side, F.col("key") == F.col("window")).select(
        "view", F.col("id").alias("key"), "doc", "item_id", "item_position", (F.col("position") - F.col("item_position")).alias("distance"),
        F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")).alias("values"),
    )
    lines = pairs.groupBy("key", "doc", "item_id", "distance", "view").agg(F.collect_set("item_position").alias("positions"), F.array_distinct(F.flatten(F.collect_set("values"))).alias("values"))
    one_value = F.size(F.array_distinct(F.transform("values", lambda v: v["a"]))) == F.size("values")
    same = F.forall("values", lambda v: v["a"].eqNullSafe(v["b"]))
    agreeing = lines.where(one_value).select("key", "doc", "item_id", "view", "positions", same.alias("same"))
    matched = lambda positions: F.size(F.array_distinct(F.flatten(F.collect_set(positions)))).cast("long")
    by_pair = agreeing.groupBy("key", "doc", "item_id").agg(
        matched(F.col("positions")).alias("matched_windows"), F.bool_and("same").alias("same_values"), *_of_views(lambda k: matched(F.when(F.col("view") == k, F.col("positions"))), "matched")
    )
    enough = [(F.col(f"matched{k}") > 0) & (F.col(f"matched{k}") >= F.col(f"total{k}") * coverage) for k in VIEWS[:2]]
    return (
        by_pair.join(totals, by_pair.item_id.eqNullSafe(totals.id))
        .where(reduce(Column.__or__, enough, F.col("matched_windows") >= F.col("item_windows") * coverage))
        .select("key", F.col("doc").alias("doc_id"), "item_id", "matched_windows", "item_windows", "same_values")
    )


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, filter_windows: int = FILTER_WINDOWS) -> DataFrame:
    """doc_id, item_id, matched and total windows, and whether slot values are the item's own."""
    return found_in_rows(docs, items, id_col, text_col, item_col, item_text, coverage, filter_windows).drop("key")


def _of_views(made: Callable[[int], Column], name: str) -> list[Column]:
    return [made(k).alias(f"{name}{k}") for k in VIEWS]


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; the keys of those are written first, so few of them cost no shuffle of texts."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        hits = found_in_rows(docs, items, "doc_id", "text", "item_id", "text", COVERAGE, FILTER_WINDOWS).select(F.col("key").alias("hit")).distinct()
        hits = materialise(hits, "bench-hits")
    return without(docs, hits)


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_template_decontamination": op4_template_decontamination}
ORACLES: dict[str, str] = {}

"""Token-id output: documents as Simple-8b coded id files, and their reader.

Documents are range-partitioned by id, each task encodes its documents in id
order and writes segment files of about SEGMENT_IDS ids; the rows that return to
Spark are a manifest of file names and counts.  Reading back is one task per few
files: the ids of a file are decoded at once and cut at the document bounds.
Global positions come from the sums per task, one number each.

File: the magic, six little-endian int64 counts (documents, ids, blocks, words,
escapes, id flags), then document ids, ids per document, block offsets, escapes
and words as 64-bit integers, then the CRC-32 of all before.

Defined results: a null or blank text is the end id alone; null ids sort first;
rows that repeat an id are separate documents in any order among themselves
(equal texts give equal rows up to `start`); an empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.llm import simple8b
from statuta.llm.shards import read_file, write_file
from statuta.llm.store import arrow_rows, materialise, scratch, table
from statuta.llm.textkit import kept, trim

MAGIC = b"S8BIDS01"
SEGMENT_IDS = 1 << 19
#: Texts that are sent to a worker at once.
BATCH_ROWS = 500
END_ID = 1
_HEAD = struct.Struct("<8s6q")

#: Letters that no normaliser step changes once lower-cased one by one; signs that no step changes and no rule joins to letters.
_LETTERS, _SIGNS = r"A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_ODD = re.compile(rf"[^ \n0-9{_LETTERS}{_SIGNS}]")
_PIECES = re.compile(rf"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+")
_WHITE = str.maketrans("\t\r\n", "   ")
_ID = attrgetter("id")


class WordEncoder:
    """Ids of whole texts, from the ids of their distinct pieces.

    The tokenizer's pattern cuts Latin letters, digits and ASCII signs but the
    apostrophe into runs of letters, single digits and runs of signs, so a text
    of these encodes as its pieces one after another, and each distinct piece
    need be encoded only once.  Letters go to the tokenizer's model directly:
    normalising leaves them lower-cased.  The pattern never joins characters
    across white space, so any other text encodes as its words one after
    another, and words with other characters take the tokenizer's whole path,
    as do texts that hold one of its special tokens.  The memories of pieces and
    of words are bounded; when full, those not met of late go, which changes no
    result.
    """

    def __init__(self, tokenizer_file: str, max_words: int = 340_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(tokenizer_file)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: "".join(p for p, _ in level.pre_tokenize_str(chr(i))) for i in range(0x61, 0x100)}
        self.pieces = _Known(self._piece, max_words)
        self.words = _Known(self._word, max_words // 2)

    def _by_library(self, piece: str) -> bytes:
        return array("I", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()

    def _piece(self, low: str) -> bytes:
        if not low[0].isalpha():
            return self._by_library(low)
        shown = low if low.isascii() else low.translate(self.letters)
        return array("I", list(map(_ID, self.model.tokenize(shown)))).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        return self._by_library(word) if _ODD.search(word) else self._plain(word)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, as 32-bit integers."""
        if not text:
            return np.zeros(0, np.uint32)
        if "\t" in text or "\r" in text:
            text = text.translate(_WHITE)
        if any(map(text.__contains__, self.special)):
            ids = self._by_library(text)
        elif _ODD.search(text):
            ids = b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        else:
            ids = self._plain(text)
        return np.frombuffer(ids, np.uint32)


class _Known(dict):
    """Results of a function by its argument, at most so many: up to half of them new, the others from before these."""

    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.half, self.before = function, max(1, most // 2), {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= 64:
            if len(self) >= self.half:
                self.before = self.copy()
                self.clear()
            self[key] = value
        return value


def encoder(tokenizer_file: str) -> WordEncoder:
    """The encoder of this Python worker, kept until a task of an operator with text kernels begins."""
    if tokenizer_file not in kept:
        kept[tokenizer_file] = WordEncoder(tokenizer_file)
    return kept[tokenizer_file]


def pack_segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    words, offsets, escapes = simple8b.encode(ids)
    flags = [1 if d is None else 0 for d in doc_ids]
    parts = [
        _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(offsets) - 1, len(words), len(escapes), sum(flags)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array(counts, "<i8").tobytes(),
        offsets.astype("<i8").tobytes(),
        escapes.astype("<u8").tobytes(),
        words.astype("<u8").tobytes(),
    ]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_segment(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids); raises on a damaged file."""
    if raw[:8] != MAGIC or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("not a whole token file")
    _, docs, n, blocks, words, escapes, nulls = _HEAD.unpack_from(raw)
    at = _HEAD.size

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += 8 * count
        return out

    doc_ids = take(docs, "<i8").tolist()
    doc_ids[:nulls] = [None] * nulls  # null ids sort first
    counts, offsets, esc = take(docs, "<i8"), take(blocks + 1, "<i8"), take(escapes, "<u8")
    return doc_ids, counts, simple8b.decode(take(words, "<u8"), offsets, esc, n)


MANIFEST = "part int, seq int, path string, docs long, ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write all documents in ascending id order; returns the manifest."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        counts: list[int] = []
        chunks: list[np.ndarray] = []
        held, last = 0, np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            path = write_file(folder, ".s8b", pack_segment(doc_ids, counts, np.concatenate(chunks)))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "docs": pa.array([len(doc_ids)], pa.int64()), "ids": pa.array([held], pa.int64())})
            seq += 1
            held = 0
            doc_ids.clear()
            counts.clear()
            chunks.clear()
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py())
                doc_ids.append(doc_id)
                counts.append(len(ids) + 1)
                chunks += [ids, last]
                held += len(ids) + 1
                if held >= segment_ids:
                    yield flush()
            trim()
        if doc_ids:
            yield flush()
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return ordered.mapInArrow(task, MANIFEST)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    spark = manifest.sparkSession
    bases, total = [], 0
    for part, ids in sorted((r.part, r.ids) for r in manifest.groupBy("part").agg(F.sum("ids").alias("ids")).collect()):
        bases.append((part, total))  # one row per writing task
        total += ids
    base = spark.createDataFrame(bases, "part int, base long")
    before = F.sum("ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(base), "part")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, counts, ids = unpack_segment(read_file(path))
                raw = ids.astype("<u4")
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "start": pa.array(start + ends - counts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.int64()),
                })
        trim()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number, or the small rows would be put together in one task
    return files.select("path", (F.col("base") + F.col("before")).alias("start")).repartition(tasks, "path").mapInArrow(task, READ)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_output(docs: DataFrame, tokenizer_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as token files in the shared folder and read them back."""
    spark = docs.sparkSession
    manifest = write_token_files(docs, scratch(spark, "token-files"), tokenizer_file or default_tokenizer(), id_col, text_col)
    with arrow_rows(spark, BATCH_ROWS):
        manifest = materialise(manifest, "token-manifest")
    return read_token_files(manifest)


def op6_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simple8b_tokens": op6_simple8b_tokens}
ORACLES: dict[str, str] = {}

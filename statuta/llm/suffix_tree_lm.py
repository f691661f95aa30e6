"""LM scoring with a probabilistic suffix tree over words.

The symbols are lower-cased words and the end of a text.  A state is a context
of 0 to DEPTH preceding words.  The tree grows from the root, one length of
context after another.  A context is a candidate when it was seen LEAST_COUNT
times in training, however large the corpus, its words without the last were a
candidate and its words without the oldest (its parent) are a state.  It becomes
a state when its next-symbol distribution diverges from its parent's: the
Kullback-Leibler divergence times its count must reach BITS_PER_SYMBOL bits for
each symbol it lists, which are those seen LEAST_PAIR times after it; the rest of
its mass goes to the parent.  Distributions are smoothed towards the parent's;
the root's are add-one.  A token is scored in the state of the longest suffix of
its history, which is found by growing the suffix while it is a state.

Counting is exact and covers all training documents, one pass for each length of
context (PIECES for the shortest, which has the most).  A sequence that is seen LEAST_PAIR times follows a candidate, and without
its oldest word it is seen as often; so a pass counts only what two bit filters,
of the candidates and of the listed shorter sequences, let through (FILTER_BITS;
a fuller filter passes more rows, never fewer); joins then leave the exact ones.  Sequences travel packed by context
and are dealt out by the hash of the whole sequence, so a context that a third
of the corpus follows goes to no single task; the number of tasks grows with the
tokens (PART_TOKENS).

The tree is a table of addends by key: what a state leaves to its parent, and
what a listed symbol adds to that.  It grows with the corpus.  Tasks are sent its
commonest HEAD_ADDENDS addends and HEAD_WORDS words, a memory bound; all others
meet the documents in a join on their keys.  The bounds change no result.

Defined results: a null or blank text is the end alone.  Null ids count as the
empty text in the fold.  Repeated rows are scored each.  Without any training
document every token has probability 1 / (N + V + 1) = 1.  An empty table gives
an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.language_id import fold
from statuta.llm.store import arrow_rows, discard, materialise, release, table
from statuta.llm.textkit import U, hash_word, mix, text_slices, word_bounds, word_hashes

DEPTH = 4
LEAST_COUNT = 16
LEAST_PAIR = 16
#: Bits of training text, per symbol it lists, that a context must save to be retained.
BITS_PER_SYMBOL = 4.0
#: Weight of the parent's distribution in a state's, in counts.
PRIOR = 8.0
#: Entries of 16 bytes that tasks are sent of the tree and of the words.
HEAD_ADDENDS, HEAD_WORDS = 2_000_000, 400_000
#: Training tokens for each task that merges counts.
PART_TOKENS = 4_000_000
#: Passes that the pairs of words are counted in, each a part of them by hash, so that their shuffle is on disk in parts.
PIECES = 2
#: Tokens after which a task sends what it has counted.
FLUSH = 1_000_000
#: Rows of an Arrow batch: a worker holds whole batches of texts.
BATCH_ROWS = 1000
#: Bits of a filter by key: 8 MB, less as it is sent.
FILTER_BITS = 1 << 26
_CHUNK = 1 << 15
_END_WORD = hash_word(b"\n")  # no word holds a line feed
_STEP = U(0x9E6C63D0676A9A99)
_STATE = U(0x5851F42D4C957F2D)  # tells the key of a state from that of its words as a sequence
_ABSENT = np.iinfo(np.int64).max


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each row's words and then its end, in order."""
    rows = len(offsets) - 1
    start, end, row = word_bounds(data, offsets)
    at = np.arange(len(start)) + row  # each earlier row adds its end
    h = np.full(len(start) + rows, _END_WORD, U)
    h[at] = word_hashes(data, start, end)
    of = np.repeat(np.arange(rows), np.bincount(row, minlength=rows) + 1)
    return h, of


def sequences(h: np.ndarray, row: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to order + 1: the keys of the words that end at each token, and whether one row has them."""
    out = [(h, np.ones(len(h), bool))]
    for _ in range(order):
        (before, whole), key, ok = out[-1], np.zeros(len(h), U), np.zeros(len(h), bool)
        key[1:] = mix(before[:-1] * _STEP + h[1:])
        ok[1:] = whole[:-1] & (row[1:] == row[:-1])
        out.append((key, ok))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted keys, whether it is there) of each wanted key."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    one, of = np.unique(wanted, return_inverse=True)  # sorted, so that the search runs along the keys
    at = np.minimum(np.searchsorted(keys, one), len(keys) - 1)
    return at[of], (keys[at] == one)[of]


def _summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, where each is found, the sum of n or the number)."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n[order], first) if len(first) else n
    return keys[first], order[first], total.astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """key, n of each distinct token of the texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, _, n = _summed(keys, n)
            return keys, n

        def rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(n), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["key", "n"])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                keys, _, n = _summed(token_hashes(data, offsets)[0])
                held.append((keys, n))
                size += len(keys)
                if size > FLUSH:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > FLUSH * 2 // 3:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*merged())

    return docs.select("text").mapInArrow(task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _pack(ctx: np.ndarray, shorter: np.ndarray, h: np.ndarray, n: np.ndarray) -> bytes:
    """Counts of sequences, in the order of their contexts, which are stored once each."""
    first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
    sizes = np.diff(np.append(first, len(ctx))).astype(np.uint32)
    return b"".join([np.array([len(first), len(h)], np.int64).tobytes(), ctx[first].tobytes(), shorter[first].tobytes(), h.tobytes(), sizes.tobytes(), n.astype(np.uint32).tobytes()])


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m, k = np.frombuffer(raw, np.int64, 2).tolist()
    ctx, shorter = np.frombuffer(raw, U, m, 16), np.frombuffer(raw, U, m, 16 + 8 * m)
    h, sizes = np.frombuffer(raw, U, k, 16 + 16 * m), np.frombuffer(raw, np.uint32, m, 16 + 16 * m + 8 * k)
    n = np.frombuffer(raw, np.uint32, k, 16 + 20 * m + 8 * k)
    return np.repeat(ctx, sizes), np.repeat(shorter, sizes), h, n


def _bit(keys: np.ndarray) -> np.ndarray:
    return (keys >> U(3)) % U(FILTER_BITS)


class KeyFilter:
    """A bit for each key that occurs, packed: FILTER_BITS of them, however many keys there are.

    It travels compressed, since each executor keeps a copy of a broadcast on disk.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __getstate__(self) -> bytes:
        return zlib.compress(self.bits.tobytes(), 1)

    def __setstate__(self, raw: bytes) -> None:
        self.bits = np.frombuffer(zlib.decompress(raw), np.uint8)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = _bit(keys)
        return (self.bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 > 0


def count_sequences(docs: DataFrame, order: int, sent: Broadcast, parts: int, piece: int = 0, pieces: int = 1) -> DataFrame:
    """key, ctx, up, n of the sequences seen LEAST_PAIR times whose first `order` words may be a candidate.

    up is the key of the sequence without its oldest word.  sent has two
    filters by key, of the candidates and of the sequences that up may be.  Of the
    sequences, by a hash, one piece of so many is counted.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ctx, shorter, h = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            keys, at, n = _summed(mix(ctx * _STEP + h))
            part = (keys >> U(32)) * U(parts) >> U(32)
            by = np.lexsort((ctx[at], part))
            at, n, part = at[by], n[by], part[by]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
            blobs = [_pack(ctx[at[a:b]], shorter[at[a:b]], h[at[a:b]], n[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_pydict({"part": pa.array(part[cuts[:-1]].astype(np.int32)), "blob": pa.array(blobs, pa.binary())})

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                h, row = token_hashes(data, offsets)
                made = sequences(h, row, order)
                at = np.flatnonzero(made[order][1])
                for those, back in zip(sent.value, (1, 0), strict=True):
                    at = at[those.may_hold(made[order - 1][0][at - back])]
                if pieces > 1:
                    at = at[(made[order][0][at] >> U(5)) % U(pieces) == piece]
                shorter = made[order - 2][0][at - 1] if order > 1 else np.zeros(len(at), U)
                held.append((made[order - 1][0][at - 1], shorter, h[at]))
                size += len(at)
                if size > FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [_unpack(x.as_py()) for batch in batches for x in batch.column(1)]
        if not blobs:
            return
        ctx, shorter, h, n = (np.concatenate(x) for x in zip(*blobs, strict=True))
        del blobs
        keys, at, n = _summed(mix(ctx * _STEP + h), n)
        often = n >= LEAST_PAIR
        keys, at, n = keys[often], at[often], n[often]
        up = mix(shorter[at] * _STEP + h[at]) if order > 1 else h[at]
        for i in range(0, len(keys), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[s].view(np.int64)) for x in (keys, ctx[at], up, n)], names=["key", "ctx", "up", "n"])

    packed = docs.select("text").mapInArrow(counted, "part int, blob binary")
    return packed.repartitionById(parts, "part").mapInArrow(merged, "key long, ctx long, up long, n long")


def key_filters(*tables: DataFrame) -> list[KeyFilter]:
    """The filter of each table's keys (one column)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            which, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U)
            for k in np.unique(which).tolist():
                at = np.unique(_bit(keys[which == k]))
                np.bitwise_or.at(bits.setdefault(k, np.zeros(FILTER_BITS // 8, np.uint8)), at >> U(3), np.uint8(1) << (at & U(7)).astype(np.uint8))
        for k, held in bits.items():
            for c in range(0, len(held), _CHUNK):
                if (part := held[c : c + _CHUNK]).any():
                    yield pa.RecordBatch.from_pydict({"which": pa.array([k], pa.int32()), "chunk": pa.array([c], pa.int32()), "bits": [part.tobytes()]})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for which, chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                got = np.frombuffer(raw.as_py(), np.uint8)
                found[which, chunk] = found[which, chunk] | got if (which, chunk) in found else got
        yield pa.RecordBatch.from_pydict({"which": pa.array([w for w, _ in found], pa.int32()), "chunk": pa.array([c for _, c in found], pa.int32()), "bits": pa.array([x.tobytes() for x in found.values()], pa.binary())})

    out = [np.zeros(FILTER_BITS // 8, np.uint8) for _ in tables]
    kind = "which int, chunk int, bits binary"
    keys = reduce(DataFrame.union, [t.select(F.lit(k).alias("which"), F.col(t.columns[0]).alias("key")) for k, t in enumerate(tables)])
    for row in keys.coalesce(16).mapInArrow(task, kind).repartition(16, "chunk").mapInArrow(merged, kind).collect():
        out[row.which][row.chunk : row.chunk + _CHUNK] = np.frombuffer(row.bits, np.uint8)
    return [KeyFilter(bits) for bits in out]


def grow(counts: DataFrame, candidates: DataFrame, lower: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """(sequences that candidates list, states among the candidates).

    candidates: ctx, shorter (the context without its oldest word), total.  lower
    has the sequences that are shorter by a word: key and log_p, the last word's
    log10 probability in its state.
    """
    spark = counts.sparkSession
    rows = counts.join(candidates, "ctx").join(lower.select(F.col("key").alias("up"), F.col("log_p").alias("above")), "up")
    rows = materialise(rows, f"lm-listed-{order}")
    release(spark)
    sums = rows.groupBy("ctx").agg(F.first("total").alias("total"), F.first("shorter").alias("shorter"), F.sum("n").alias("shown"), F.count("*").alias("listed"), F.sum(F.pow(F.lit(10.0), "above")).alias("above_sum"))
    left = F.col("total") - F.col("shown") + PRIOR
    p = (F.col("n") + left * F.pow(F.lit(10.0), "above")) / (F.col("total") + PRIOR)
    saved = rows.select("ctx", "n", "above").join(sums.select("ctx", "total", "shown"), "ctx").withColumn("p", p)
    saved = saved.groupBy("ctx").agg(F.sum("p").alias("p_sum"), F.sum(F.col("n") * (F.log2("p") - F.col("above") * float(np.log2(10)))).alias("listed_gain"))
    least = F.lit(1e-12)
    rest_gain = (F.col("total") - F.col("shown")) * F.log2(F.greatest(1 - F.col("p_sum"), least) / F.greatest(1 - F.col("above_sum"), least))
    judged = sums.join(saved, "ctx").withColumn("gain", F.col("listed_gain") + rest_gain)
    kept = judged.where(F.col("gain") >= BITS_PER_SYMBOL * (F.col("listed") + 1))
    states = materialise(kept.select("ctx", "shorter", "total", "shown", "listed", "gain", F.log10(left / (F.col("total") + PRIOR)).alias("rest")), f"lm-states-{order}")
    release(spark)
    log_p = F.when(F.col("rest").isNull(), F.col("above")).otherwise(F.log10(p))
    named = rows.select("key", "ctx", "up", "n", "above").join(states.select("ctx", "total", "shown", "rest"), "ctx", "left")
    listed = materialise(named.select("key", "up", "n", log_p.alias("log_p"), (log_p - F.col("above") - F.col("rest")).alias("value")), f"lm-tree-{order}")
    discard(rows)
    release(spark)
    return listed, states


@dataclass
class Model:
    """words: key, n.  orders: for contexts of 1, 2, ... words, what grow() gives."""

    words: DataFrame
    tokens: int
    distinct: int
    orders: list[tuple[DataFrame, DataFrame]]

    def addends(self) -> DataFrame | None:
        """key, value, n of the tree."""
        parts = []
        for listed, states in self.orders:
            parts.append(listed.where("value is not null").select("key", "value", "n"))
            parts.append(states.select(F.col("ctx").bitwiseXOR(F.lit(int(_STATE.view(np.int64)))).alias("key"), F.col("rest").alias("value"), F.col("total").alias("n")))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def report(self) -> DataFrame:
        """length, states, listed symbols and bits saved, for each length of context."""
        rows = [s.agg(F.lit(k).alias("length"), F.count("*").alias("states"), F.sum("listed").alias("listed"), F.sum("gain").alias("bits")) for k, (_, s) in enumerate(self.orders, 1)]
        return reduce(DataFrame.unionByName, rows) if rows else self.words.limit(0).selectExpr("0 as length", "n as states", "n as listed", "0.0 as bits")


def train(docs: DataFrame, depth: int = DEPTH) -> Model:
    """The tree of all docs (text)."""
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS):
        words = materialise(count_words(docs), "lm-words")
        release(spark)
        tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART_TOKENS))
        lower = words.where(F.col("n") >= LEAST_PAIR).select("key", F.log10((F.col("n") + 1) / F.lit(float(tokens + distinct + 1))).alias("log_p"))
        candidates = words.where(F.col("n") >= LEAST_COUNT).select(F.col("key").alias("ctx"), F.lit(0).cast("long").alias("shorter"), F.col("n").alias("total"))
        orders = []
        for order in range(1, depth + 1):
            filters = key_filters(candidates.select("ctx"), lower.select("key"))
            release(spark)
            if not filters[0].bits.any():
                break
            sent = spark.sparkContext.broadcast(filters)
            pieces = PIECES if order == 1 else 1
            counts = []
            for piece in range(pieces):
                counts.append(materialise(count_sequences(docs, order, sent, parts, piece, pieces), f"lm-counts-{order}"))
                release(spark)
            sent.destroy()  # the counts are in tables now
            listed, states = grow(reduce(DataFrame.unionByName, counts), candidates, lower, order)
            discard(*counts)
            orders.append((listed, states))
            # a candidate's count is that of its words as a sequence, since each word has a follower
            candidates = listed.where(F.col("n") >= LEAST_COUNT).join(states.select(F.col("ctx").alias("up")), "up", "left_semi").select(F.col("key").alias("ctx"), F.col("up").alias("shorter"), F.col("n").alias("total"))
            lower = listed.select("key", "log_p")
    return Model(words, tokens, distinct, orders)


def head_and_others(entries: DataFrame, most: int) -> tuple[pa.Table, DataFrame]:
    """(the `most` commonest entries at most, as a table; all others), by their column n."""
    step = F.floor(F.log2("n") * 4)
    sizes = sorted(((r.step, r.size) for r in entries.groupBy(step.alias("step")).agg(F.count("*").alias("size")).collect()), reverse=True)  # a row for each fourth of a power of two
    least, held = _ABSENT, 0
    for k, size in sizes:
        held += size
        if held > most:
            break
        least = k
    return entries.where(step >= least).toArrow(), entries.where(step < least)


class Head:
    """What tasks are sent: the commonest words and addends, and filters of the others."""

    def __init__(self, words: pa.Table, addends: pa.Table | None, scale: int, other_words: KeyFilter | None, other_addends: KeyFilter | None):
        keys, n = words["key"].to_numpy().view(U), words["n"].to_numpy()
        order = np.argsort(keys)
        self.words, self.log_p = keys[order], np.log10((n[order] + 1) / scale)
        keys, values = (addends["key"].to_numpy().view(U), addends["value"].to_numpy()) if addends is not None else (np.zeros(0, U), np.zeros(0))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.other_words, self.other_addends = other_words, other_addends

    def roots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability at the root, whether the word is sent) of each token."""
        at, found = _find(self.words, h)
        out = np.zeros(len(h))
        out[found] = self.log_p[at[found]]
        return out, found

    def added(self, h: np.ndarray, row: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What contexts add to each token's log10 probability, and (key, token) of the addends that a join must give."""
        out, keys, tokens = np.zeros(len(h)), [np.zeros(0, U)], [np.zeros(0, np.int64)]
        made = sequences(h, row, depth)
        at = np.arange(len(h))
        for order in range(1, depth + 1):
            at = at[made[order][1][at]]
            deeper = at[:0]
            for before in (True, False):  # the state, then the symbol it lists: without the one there is no other
                key = made[order - 1][0][at - 1] ^ _STATE if before else made[order][0][at]
                place, found = _find(self.keys, key)
                out[at[found]] += self.values[place[found]]
                more = ~found
                more[more] = self.other_addends.may_hold(key[more]) if self.other_addends is not None else False
                keys.append(key[more])
                tokens.append(at[more])
                at = at[found | more]
                deeper = at if before else deeper
            at = deeper  # a longer suffix is a state only if this one is
        return out, np.concatenate(keys), np.concatenate(tokens)


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_rare long, rare array<long>"


def score_pass(docs: DataFrame, sent: Broadcast, depth: int) -> DataFrame:
    """The scores of each row as far as the Head that tasks are sent knows them, and the keys of its other words and addends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sent.value
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, rows, data, offsets in text_slices(batch.column(2)):
                h, row = token_hashes(data, offsets)
                base, known = head.roots(h)
                rare = np.flatnonzero(~known)
                added, keys, tokens = head.added(h, row, depth)
                asked = rare[head.other_words.may_hold(h[rare])] if head.other_words is not None else rare[:0]
                of = np.concatenate([row[asked], row[tokens]])
                order = np.argsort(of, kind="stable")
                of, keys = of[order], np.concatenate([h[asked], keys])[order]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + rows)), batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), pa.array(np.bincount(row, minlength=rows)),
                        pa.array(np.bincount(row[known], minlength=rows)), pa.array(np.bincount(row, weights=base, minlength=rows)), pa.array(np.bincount(row, weights=base + added, minlength=rows)), pa.array(np.bincount(row[rare], minlength=rows)),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)), pa.int32()), pa.array(keys.view(np.int64))),
                    ],
                    names=[x.split()[0] for x in SCORED.split(", ")],
                )
                uid += rows

    return docs.select("doc_id", "held_out", "text").mapInArrow(task, SCORED)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, head_words: int = HEAD_WORDS, head_addends: int = HEAD_ADDENDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, 7) == 2).alias("held_out"), F.col(text_col).alias("text"))
    spark = rows.sparkSession
    model = train(rows.where(~F.col("held_out")), depth)
    words, other_words = head_and_others(model.words, head_words)
    others = other_words.select("key", F.lit(1).alias("word"), F.log10(F.col("n") + 1.0).alias("value"))
    addends = found = None
    tree = model.addends()
    if tree is not None:
        addends, found = head_and_others(tree, head_addends)
        others = others.unionByName(found.select("key", F.lit(0).alias("word"), "value"))
        found = None if found.isEmpty() else key_filters(found.select("key"))[0]
    scale = model.tokens + model.distinct + 1
    head = Head(words, addends, scale, None if other_words.isEmpty() else key_filters(other_words.select("key"))[0], found)
    with arrow_rows(spark, BATCH_ROWS):
        sent = spark.sparkContext.broadcast(head)
        scored = materialise(score_pass(rows, sent, depth), "lm-scored")
        sent.destroy()
    release(spark)
    more = scored.select("uid", F.explode("rare").alias("key")).join(others, "key").groupBy("uid").agg(
        F.sum("word").alias("more"), F.sum(F.when(F.col("word") == 1, F.col("value"))).alias("logs"), F.sum(F.when(F.col("word") == 0, F.col("value"))).alias("added")
    )
    in_class = F.coalesce("logs", F.lit(0.0)) - F.col("n_rare") * F.log10(F.lit(float(scale)))
    return scored.join(more, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + in_class).alias("base_score"),
        (F.col("score") + in_class + F.coalesce("added", F.lit(0.0))).alias("score"),
    )


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_suffix_tree": op1_suffix_tree}
ORACLES: dict[str, str] = {}

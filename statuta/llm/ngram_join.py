"""N-gram Jaccard join: prefix filters under several global orders.

A document's set is its distinct 5-word shingles, as 64-bit hashes.  Two sets
whose Jaccard similarity is at least 0.8 share a shingle among the first
|s| - ceil(0.8 |s|) + 1 of each, under any order of all shingles, and the number
they share there has a lower bound by their sizes (least_shared).  Of the smaller
set the first |s| - ceil(8 |s| / 9) + 1 do, since its partner is as large.  Each order
here puts rare shingles first (by the counts of a fixed-size sketch of the whole
corpus, so it is the same function for every document) and ranks equals by a
hash of its own.  A candidate pair must share enough prefix tokens under every
order; size and bitmap bounds, both exact, drop more, and what is left is
verified on whole sets.

Steps, none of which lists the pairs of a group:
1. one pass over the texts gives each document the 128-bit digest of its set;
   documents with equal sets are one node from here on; the pass also fills the
   sketch (summed by executors);
2. a second pass sends the prefix tokens of each node, packed, to the token's
   partition, where tokens of a single node are dropped;
3. in each bucket (the nodes of one token) all nodes are compared with one
   leader, the node with the commonest shingles; verified links give components;
4. nodes of different components meet where a token is in the short prefix of
   the smaller one and the long prefix of the larger; their verified links are
   added.
Step 4 is exact: a pair that is never compared is already in one component.
Texts that share boilerplate without being near don't meet in it: their own rare
shingles come first, and more than a ninth of a text is beyond the short prefix.
What step 4 costs grows with the pairs of different components that share rare
shingles; texts just below the threshold to one another are such pairs.

The result has components; the links found in one are enough to hold it
together, and links within a component that nothing depends on are not sought.

Defined results: words are as the contract of the query says; a text without
words has the empty set and links with nothing; one with fewer than five words
has its whole sequence as its only shingle.  Null texts are empty.  A null id
takes part through its set and is never a component's id unless all ids are
null.  Rows that repeat an id are joined with it by id only if their sets link.
An empty table gives an empty result.  Extra columns are ignored by the join and
kept by keep_one_of_each().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.components import components
from statuta.llm.store import arrow_rows, discard, materialise, release, row_key, table
from statuta.llm.textkit import U, mix, shingle_hashes, text_slices, trim, word_bounds, word_hashes

ORDERS = 2
#: Counters of the sketch: four for each document, within these bounds (64 MB at most).
LEAST_CELLS, MOST_CELLS = 1 << 21, 1 << 24
_CHUNK = 1 << 15
_BITS = 512
#: Bits of the filter by id: 1 MB packed; beyond a few million ids it passes more rows, never fewer.
FILTER_BITS = 1 << 23
#: Rows of an Arrow batch: texts and sets are large, and a worker holds whole batches.
BATCH_ROWS = 500
#: Prefix tokens that a task sends at once, and that one part of them holds.
FLUSH, PART_TOKENS = 600_000, 2_000_000
#: Similarity as a ratio of integers.
NUM, DEN = 4, 5


def slice_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, shingle hashes, their rows) for runs of rows."""
    for at, rows, data, offsets in text_slices(column):
        start, end, row = word_bounds(data, offsets)
        h, r = shingle_hashes(word_hashes(data, start, end), row, rows, k)
        yield at, rows, h, r


def digests(h: np.ndarray, r: np.ndarray, rows: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, node, check) of each row's set: two independent 64-bit sums."""
    n = np.bincount(r, minlength=rows).astype(np.int64)
    out = []
    for seed in (salt * 2 + 1, salt * 2 + 2):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ mix(np.array([seed], U))), dtype=U)])
        ends = np.cumsum(n)
        out.append(mix(total[ends] - total[ends - n] + n.astype(U)))
    return n, out[0].view(np.int64), out[1].view(np.int64)


def set_pass(docs: DataFrame, salt: int, cells: int) -> DataFrame:
    """Rows of documents (doc_id, key, n, node, check) and of sketch chunks (chunk, counts)."""
    names = ["doc_id", "key", "n", "node", "check", "chunk", "counts"]
    shift = U(64 - cells.bit_length() + 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(cells, np.uint32)
        for batch in batches:
            for at, rows, h, r in slice_sets(batch.column(2)):
                cell, n = np.unique((h >> shift).astype(np.int64), return_counts=True)
                sketch[cell] += n.astype(np.uint32)
                n, node, check = digests(h, r, rows, salt)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), pa.array(n), pa.array(node), pa.array(check), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        used = [c for c in range(cells // _CHUNK) if sketch[c * _CHUNK : (c + 1) * _CHUNK].any()]
        packed = [zlib.compress(sketch[c * _CHUNK : (c + 1) * _CHUNK].tobytes(), 1) for c in used]
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return docs.select("doc_id", "key", "text").mapInArrow(task, "doc_id long, key long, n long, node long, check long, chunk int, counts binary")


def sketch_levels(first: DataFrame, cells: int) -> np.ndarray:
    """How common the shingles of each cell are: 0 within the noise, then in powers of two."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(zlib.decompress(raw.as_py()), np.uint32)
                sums[chunk] = sums[chunk] + got if chunk in sums else got.astype(np.uint64)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())})

    counts = np.zeros(cells, np.uint64)
    summed = first.where("chunk is not null").select("chunk", "counts").repartition(16, "chunk").mapInArrow(task, "chunk int, counts binary")
    for row in summed.collect():  # `cells` numbers in all, compressed
        counts[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(zlib.decompress(row.counts), np.uint64)
    mean = float(counts.mean())
    unit = 4 * mean**0.5 + 4  # rare shingles alone fill a cell to about its mean, give or take its root
    return np.floor(np.log2(np.maximum((counts - mean) / unit, 0.5)) + 1).astype(np.uint8)


_FEATURE = np.dtype([("node", "<i8"), ("n", "<i8"), ("met", "<i4"), ("weight", "<f4"), ("bits", "<i8", (_BITS // 64,))])
_ROW = np.dtype([("token", "<u4"), ("node", "<u4")])
_SHORT = 1 << 31  # marks, beside the node, a token of its short prefix


def _met(image: np.ndarray, r: np.ndarray, rows: int) -> np.ndarray:
    """How many tokens of each row look like an earlier one of it."""
    order = np.lexsort((image, r))
    image, r = image[order], r[order]
    return np.bincount(r[1:][(image[1:] == image[:-1]) & (r[1:] == r[:-1])], minlength=rows)


def prefix_pass(docs: DataFrame, levels: np.ndarray, salt: int, parts: int, orders: int) -> DataFrame:
    """Packed prefix tokens and features, by (kind, part): kind 0 holds features, k order k."""
    held = docs.sparkSession.sparkContext.broadcast(levels)
    shift = U(64 - len(levels).bit_length() + 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rows_of: list[list[np.ndarray]] = [[] for _ in range(orders)]
        features: list[np.ndarray] = []
        nodes = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal nodes, size
            kinds, part, blobs = [], [], []
            feature = np.concatenate(features)
            of = (feature["node"].view(U) % U(parts)).astype(np.int64)
            for p in np.unique(of):
                kinds.append(0)
                part.append(int(p))
                blobs.append(feature[of == p].tobytes())
            for k in range(orders):
                rows = np.concatenate(rows_of[k]) if rows_of[k] else np.zeros((0, 2), U)
                of = (rows[:, 0] >> U(32)) % U(parts)
                order = np.argsort(of, kind="stable")
                rows, of = rows[order], of[order]
                cuts = np.flatnonzero(np.diff(of)) + 1
                for piece, p in zip(np.split(rows, cuts), of[np.concatenate([[0], cuts])] if len(of) else [], strict=False):
                    used, index = np.unique(piece[:, 1] >> U(1), return_inverse=True)
                    packed = np.zeros(len(piece), _ROW)
                    packed["token"], packed["node"] = piece[:, 0] & U(0xFFFFFFFF), index + (piece[:, 1] & U(1)).astype(np.int64) * _SHORT
                    names = feature["node"][used.astype(np.int64)]
                    kinds.append(k + 1)
                    part.append(int(p))
                    blobs.append(np.int64(len(names)).tobytes() + names.tobytes() + packed.tobytes())
                rows_of[k].clear()
            features.clear()
            nodes = size = 0
            return pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.int32()), "part": pa.array(part, pa.int32()), "blob": pa.array(blobs, pa.binary())})

        for batch in batches:
            for _, rows, h, r in slice_sets(batch.column(0)):
                n, node, _ = digests(h, r, rows, salt)
                fresh = np.zeros(rows, bool)
                for i in np.flatnonzero(n > 0).tolist():
                    if (x := int(node[i])) not in seen:
                        seen.add(x)
                        fresh[i] = True
                keep = fresh[r]
                h, r = h[keep], (np.cumsum(fresh) - 1)[r[keep]]
                n, node = n[fresh], node[fresh]
                if not len(n):
                    continue
                level = held.value[(h >> shift).astype(np.int64)]
                feature = np.zeros(len(n), _FEATURE)
                feature["node"], feature["n"] = node, n
                feature["weight"] = np.bincount(r, weights=level, minlength=len(n)) / n
                odd = np.bincount(r * _BITS + (h & U(_BITS - 1)).astype(np.int64), minlength=len(n) * _BITS) & 1
                feature["bits"] = np.packbits(odd.reshape(len(n), _BITS).astype(np.uint8), axis=1).view("<i8")
                first = np.cumsum(n) - n
                place = np.arange(len(h)) - first[r]
                length = n - -(-n * NUM // DEN) + 1
                short = n - -(-n * 2 * NUM // (NUM + DEN)) + 1
                for k in range(orders):
                    token = mix(h ^ mix(np.array([977 + k], U)))
                    rank = (level.astype(U) << U(56)) | (token >> U(8))
                    order = np.lexsort((rank, r))
                    inside = place < length[r]
                    pick, of = order[inside], r[inside]  # r is in order, so the place within a row stays
                    token = token[pick]
                    rows_of[k].append(np.column_stack([token, ((of + nodes).astype(U) << U(1)) | (place[inside] < short[of]).astype(U)]))
                    image = (((token >> U(32)) % U(parts)) << U(32)) | (token & U(0xFFFFFFFF))
                    feature["met"] = np.maximum(feature["met"], _met(image, of, len(n)))
                    size += len(pick)
                features.append(feature)
                nodes += len(n)
                if size > FLUSH:  # bounds what a task holds
                    yield flush()
        if nodes:
            yield flush()

    return docs.select("text").mapInArrow(task, "kind int, part int, blob binary")


_BIT_COLUMNS = [f"bits{i}" for i in range(_BITS // 64)]


def bucket_rows(packed: DataFrame, parts: int) -> DataFrame:
    """(kind, token, node, short, n, met, weight, bits...): kind 0 features, kind k the shared tokens of order k."""
    names = ["kind", "token", "node", "short", "n", "met", "weight", *_BIT_COLUMNS]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.float32(), *[pa.int64()] * len(_BIT_COLUMNS)]
    sql = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.float32(): "float"}

    def emit(kind: int, part: int, blobs: list[bytes]) -> pa.RecordBatch:
        if kind == 0:
            f = np.concatenate([np.frombuffer(b, _FEATURE) for b in blobs])
            f = f[np.unique(f["node"], return_index=True)[1]]
            columns = [pa.array(np.zeros(len(f), np.int32)), pa.nulls(len(f), pa.int64()), pa.array(f["node"]), pa.nulls(len(f), pa.bool_()), pa.array(f["n"]), pa.array(f["met"]), pa.array(f["weight"]), *[pa.array(np.ascontiguousarray(f["bits"][:, i])) for i in range(len(_BIT_COLUMNS))]]
        else:
            tokens, nodes, shorts = [], [], []
            for b in blobs:
                m = int(np.frombuffer(b, np.int64, 1)[0])
                rows = np.frombuffer(b, _ROW, offset=8 + 8 * m)
                tokens.append(rows["token"])
                shorts.append(rows["node"] >= _SHORT)
                nodes.append(np.frombuffer(b, np.int64, m, 8)[rows["node"] & np.uint32(_SHORT - 1)])
            token, node, short = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(shorts)
            order = np.lexsort((~short, node, token))  # of tokens that look alike, one of the short prefix first
            token, node, short = token[order], node[order], short[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, short = token[new], node[new], short[new]
            shared = np.zeros(len(token), bool)
            shared[1:] = token[1:] == token[:-1]
            shared[:-1] |= shared[1:]
            token, node, short = token[shared], node[shared], short[shared]
            whole = token.astype(np.int64) + (np.int64(part) << 32)
            columns = [pa.array(np.full(len(token), kind, np.int32)), pa.array(whole), pa.array(node), pa.array(short), *[pa.nulls(len(token), t) for t in kinds[4:]]]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        for batch in batches:
            for kind, part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at not in (None, (kind, part)):
                    yield emit(*at, blobs)
                    blobs = []
                at = (kind, part)
                blobs.append(blob)
        if blobs:
            yield emit(*at, blobs)
        blobs = []
        trim()

    schema = ", ".join(f"{n} {sql[t]}" for n, t in zip(names, kinds, strict=True))
    return packed.repartitionById(parts, "part").sortWithinPartitions("kind", "part").mapInArrow(task, schema)


def _may_link(a: str, b: str) -> Column:
    """Size and bitmap bounds of rows with prefixes a and b: exact, no pair that links fails."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) for c in _BIT_COLUMNS), F.lit(0))
    return (n * DEN >= m * NUM) & (m * DEN >= n * NUM) & (apart * (DEN + NUM) <= (n + m) * (DEN - NUM))


def _renamed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def _pair(a: str, b: str) -> list[Column]:
    """x, y, least (see least_shared) of rows with prefixes a and b."""
    x, y = F.col(f"{a}node"), F.col(f"{b}node")
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), least_shared(F.col(f"{a}n"), F.col(f"{b}n"), F.least(f"{a}met", f"{b}met")).alias("least")]


def least_shared(n: Column, m: Column, met: Column) -> Column:
    """How many tokens the prefixes of a pair of sizes n, m that links share, under any order.

    Linked sets have at least a = ceil(4 (n + m) / 9) shingles in common, so of the
    first p of a set at most n - a are not shared: prefixes of n - a + l and
    m - a + l tokens share l.  met of them may look alike, since 32 bits and the
    part's number stand for a token.
    """
    common = F.ceil((n + m) * NUM / (NUM + DEN))
    spare = lambda k: common - F.ceil(k * NUM / DEN) + 1  # noqa: E731  of a prefix of k - ceil(k NUM / DEN) + 1 tokens
    return F.greatest(F.least(spare(n), spare(m)) - met, F.lit(1))


def in_every_order(pairs: DataFrame, buckets: list[DataFrame]) -> DataFrame:
    """The pairs (x, y, least) that share enough prefix tokens under each of the orders."""
    for bucket in buckets:
        mine = bucket.select(F.col("node").alias("x"), "token")
        theirs = bucket.select(F.col("node").alias("y"), "token")
        pairs = pairs.join(mine, "x").join(theirs, ["y", "token"]).groupBy("x", "y", "least").agg(F.count("*").alias("shared")).where(F.col("shared") >= F.col("least")).drop("shared")
    return pairs


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of an id that occurs: FILTER_BITS of them, however many ids there are."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_id_bit(batch.column(0))] = True
        for c in range(FILTER_BITS // _CHUNK):
            if (part := bits[c * _CHUNK : (c + 1) * _CHUNK]).any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "bits": [np.packbits(part).tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(raw.as_py(), np.uint8)
                found[chunk] = found[chunk] | got if chunk in found else got
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(found), pa.int32()), "bits": pa.array([x.tobytes() for x in found.values()], pa.binary())})

    out = np.zeros(FILTER_BITS, bool)
    kind = "chunk int, bits binary"
    for row in ids.coalesce(16).mapInArrow(task, kind).repartition(16, "chunk").mapInArrow(merge, kind).collect():
        out[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.unpackbits(np.frombuffer(row.bits, np.uint8))
    return out


def _id_bit(ids: pa.Array) -> np.ndarray:
    return (mix(ids.fill_null(0).to_numpy().view(U)) % U(FILTER_BITS)).astype(np.int64)


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, salt: int) -> DataFrame:
    """The pairs whose whole sets are similar enough; sets are made again from one text each.

    Texts are not shuffled: the scan passes over rows whose id is surely not
    wanted, and only sets travel, to be joined by node.
    """
    spark = docs.sparkSession
    involved = materialise(pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct(), "join-involved")
    wanted = spark.sparkContext.broadcast(id_filter(reps.join(involved, "node").select("rep")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(wanted.value[_id_bit(batch.column(0))])
            for _, rows, h, r in slice_sets(batch.column(1).filter(hit)):
                n, node, _ = digests(h, r, rows, salt)
                ends = np.cumsum(n)
                raw = [h[e - m : e].tobytes() for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(raw, pa.binary())], names=["node", "members"])

    made = docs.select("doc_id", "text").mapInArrow(sets, "node long, members binary").join(involved, "node", "left_semi")
    members = materialise(made.groupBy("node").agg(F.first("members").alias("members")), "join-sets")
    both = pairs.join(members.select(F.col("node").alias("x"), F.col("members").alias("a")), "x").join(members.select(F.col("node").alias("y"), F.col("members").alias("b")), "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(a.as_py(), U), np.frombuffer(b.as_py(), U)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(common * DEN >= NUM * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))
        trim()

    links = materialise(both.select("x", "y", "a", "b").mapInArrow(compare, "x long, y long"), "join-links")
    discard(members, involved)
    wanted.unpersist()
    release(spark)
    return links


def jaccard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS, salt: int = 0) -> DataFrame:
    """doc_id, key (of id and text), n_shingles, component (null without words), component_id of every row of docs."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(docs, id_col, text_col).alias("key"), F.col(text_col).alias("text"))
        return _jaccard_rows(keyed, orders, salt)


def _jaccard_rows(docs: DataFrame, orders: int, salt: int) -> DataFrame:
    spark = docs.sparkSession
    cells = min(max(1 << (4 * docs.count()).bit_length(), LEAST_CELLS), MOST_CELLS)
    first = materialise(set_pass(docs, salt, cells), "join-docs")
    per_doc = first.where("chunk is null").select("doc_id", "key", "n", "node", "check")
    nodes = per_doc.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
    reps = materialise(nodes, "join-nodes")
    found = reps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("low") != F.col("high")).alias("met")).first()
    if found.met:
        return _jaccard_rows(docs, orders, salt + 1)  # two sets met in 64 bits: other sums
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.n // (DEN * PART_TOKENS)))
    packed = prefix_pass(docs, sketch_levels(first, cells), salt, parts, orders)
    rows = materialise(bucket_rows(packed, parts), "join-buckets", partition_by="kind")
    release(spark)
    features = rows.where("kind = 0").drop("kind", "token", "short")
    tokens = [rows.where(F.col("kind") == k).select("token", "node", "short") for k in range(1, orders + 1)]
    bucket = materialise(tokens[0].join(features, "node"), "join-prefixes")
    release(spark)
    leader = bucket.groupBy("token").agg(F.max(F.struct("weight", "n", "node", "met", *_BIT_COLUMNS)).alias("l")).select("token", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("n", "node", "met", *_BIT_COLUMNS)])
    stars = bucket.join(leader, "token").where((F.col("node") != F.col("l_node")) & _may_link("", "l_")).select(*_pair("", "l_")).distinct()
    candidates = materialise(in_every_order(stars, tokens[1:]).select("x", "y"), "join-stars")
    links = verified(candidates, docs, reps, salt)
    label = components(links)
    release(spark)
    placed = bucket.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    left, right = _renamed(placed.where("short").drop("short", "weight"), "a_", "token"), _renamed(placed.drop("short", "weight"), "b_", "token")
    smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_node") < F.col("b_node")))
    apart = left.join(right, "token").where(smaller & (F.col("a_component") != F.col("b_component")) & _may_link("a_", "b_"))
    rest = in_every_order(apart.select(*_pair("a_", "b_")).distinct(), tokens)
    rest = materialise(rest.select("x", "y").join(candidates, ["x", "y"], "left_anti"), "join-rest")
    named = reps.select("node", "rep").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not rest.isEmpty():
        of = lambda end: label.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
        more = verified(rest, docs, reps, salt).join(of("x"), "x", "left").join(of("y"), "y", "left")
        above = components(more.select(F.coalesce("x_component", "x").alias("x"), F.coalesce("y_component", "y").alias("y")))
        named = named.join(above.select(F.col("node").alias("component"), F.col("component").alias("above")), "component", "left").withColumn("component", F.coalesce("above", "component"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = materialise(named.select("node", "component").join(smallest, "component"), "join-components")
    discard(bucket, rows, candidates, rest, links)
    release(spark)
    of_node = of_node.select(F.col("node").alias("of"), "component", "component_id")
    named = per_doc.join(of_node, (F.col("node") == F.col("of")) & (F.col("n") > 0), "left")
    return named.select("doc_id", "key", F.col("n").alias("n_shingles"), "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    return jaccard_rows(docs, id_col, text_col, orders).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest id (nulls last), with all its columns.

    Rows without words link with nothing and all stay.  Rows that repeat an id
    with other texts are rows of their own; of rows that repeat id and text one stays.
    """
    found = materialise(jaccard_rows(docs), "join-rows").where("component is not null")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("key").alias("c"))
    stays = found.groupBy("component").agg(F.min(order).alias("least"))
    chosen = found.join(stays, "component").select("key", (F.col("key") == F.col("least.c")).alias("stays"))
    keys = chosen.groupBy("key").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n"))
    not_alone = materialise(keys.where("not stays or n > 1").select(F.col("key").alias("of"), "stays"), "join-not-alone")
    rows = docs.select(F.struct("*").alias("row"), row_key(docs).alias("key"))
    alone = rows.join(not_alone, F.col("key") == F.col("of"), "left_anti").select("row.*")
    again = rows.join(not_alone.where("stays"), F.col("key") == F.col("of"), "left_semi")
    return alone.unionByName(again.groupBy("key").agg(F.first("row").alias("row")).select("row.*"))


def op2_multi_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op2_multi_order_join": op2_multi_order_join}
ORACLES: dict[str, str] = {}

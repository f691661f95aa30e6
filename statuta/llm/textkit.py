"""Vectorised byte kernels shared by the Arrow operators of this package.

All kernels work on the UTF-8 buffer of an Arrow string column, so a batch of
documents is handled without one Python object per word.  A word is a maximal
run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; documents
never share a word.  Null texts are empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_PINV = pow(_P, -1, 1 << 64)
_SHINGLE = [0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3]
#: Bytes of text that one kernel call handles; a longer document is handled alone, in pieces of this size.
SLICE_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n (SLICE_BYTES + 1 at most) powers of _P and of its inverse, kept for the next call."""
    if not _pow:
        for base in (_P, _PINV):
            p = np.full(SLICE_BYTES + 1, base, dtype=U)
            p[0] = 1
            _pow.append(np.multiply.accumulate(p))
    return _pow[0][:n], _pow[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def trim() -> None:
    """Give free memory back to the system: workers live on after their tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL(None)
except OSError:  # no such library here
    _libc = None


#: What operators without these kernels keep in this worker between their tasks, by name.
kept: dict[str, object] = {}


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, row offsets) for runs of rows of about SLICE_BYTES."""
    kept.clear()  # a worker that comes to another operator needs it no more
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off_buf, data_buf = column.buffers()
    offsets = np.frombuffer(off_buf, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        j = min(j, n)
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    trim()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of the rows, in order."""
    n, starts, ends, solid_before = len(data), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
    for a in range(0, n, SLICE_BYTES):
        b = min(a + SLICE_BYTES, n)
        solid = ~SPACE[data[a:b]]
        edge = np.zeros(b - a + 1, dtype=bool)  # where a row begins
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a] = True
        before = np.concatenate([[solid_before], solid[:-1]])
        after = np.concatenate([solid[1:], [b < n and not SPACE[data[b]]]])
        starts.append(np.flatnonzero(solid & (~before | edge[:-1])) + a)
        ends.append(np.flatnonzero(solid & (~after | edge[1:])) + a + 1)
        solid_before = solid[-1]
    start, end = np.concatenate(starts), np.concatenate(ends)
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each word [start, end), which are in order; fold maps bytes, lower-casing them by default."""
    out = np.empty(len(start), dtype=U)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = int(np.searchsorted(end, a + SLICE_BYTES, side="right"))
        if j <= i:
            out[i] = _long_word(fold[data[a : end[i]]])
            i += 1
            continue
        piece = data[a : end[j - 1]]
        p, inv = _powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, dtype=U)
        np.cumsum((fold[piece].astype(U) + U(1)) * p[:-1], out=total[1:])
        out[i:j] = (total[end[i:j] - a] - total[start[i:j] - a]) * inv[start[i:j] - a]
        i = j
    return mix(out)


def _long_word(word: np.ndarray) -> int:
    """The unmixed hash of a folded word longer than a slice."""
    total, scale, step = 0, 1, pow(_P, SLICE_BYTES, 1 << 64)
    p, _ = _powers(SLICE_BYTES)
    for a in range(0, len(word), SLICE_BYTES):
        piece = word[a : a + SLICE_BYTES]
        total += int(np.sum((piece.astype(U) + U(1)) * p[: len(piece)], dtype=U)) * scale
        scale = scale * step % (1 << 64)
    return total % (1 << 64)


def hash_word(word: bytes) -> int:
    """word_hashes of one word, for tests and fixed tokens."""
    data = np.frombuffer(word, dtype=np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def shingle_hashes(words: np.ndarray, row: np.ndarray, rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct k-word shingles, by row then hash.

    A row with 1 to k-1 words has its whole sequence as one shingle; a row
    without words has none.
    """
    n = len(words)
    counts = np.bincount(row, minlength=rows) if n else np.zeros(rows, np.int64)
    firsts = np.cumsum(counts) - counts
    parts_h, parts_r = [], []
    if n >= k:
        h = np.zeros(n - k + 1, dtype=U)
        for j in range(k):
            h += words[j : n - k + 1 + j] * U(_SHINGLE[j % 5] + 2 * (j // 5))
        ok = row[: n - k + 1] == row[k - 1 :]
        parts_h.append(mix(h[ok]))
        parts_r.append(row[: n - k + 1][ok])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        hs = np.full(len(short), 0x5851F42D4C957F2D, dtype=U)
        for j in range(k - 1):
            has = counts[short] > j
            hs[has] = mix(hs[has] * U(_SHINGLE[j % 5]) + words[firsts[short][has] + j])
        parts_h.append(hs ^ counts[short].astype(U))
        parts_r.append(short)
    if not parts_h:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h, r = np.concatenate(parts_h), np.concatenate(parts_r)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[keep], r[keep]

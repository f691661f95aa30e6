"""Simple-8b: word-aligned coding of unsigned integers, in numpy.

A 64-bit word holds a 4-bit selector and 60 bits of payload; the selector says
how many values of which width the payload packs, lowest bits first.  Selector 0
is an escape: its payload is an index into a table of raw 64-bit values, so any
unsigned 64-bit value can be coded.  Values are coded in blocks of BLOCK values,
each starting at a word of its own; the word offsets of the blocks let a reader
decode any block, and all blocks at once without a loop over values.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BLOCK = 4096
#: Values in a word and bits of a value, by selector; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
_POWERS = U(1) << np.arange(61, dtype=U)


_BITS16 = np.maximum(np.searchsorted(_POWERS, np.arange(1 << 16, dtype=U), side="right"), 1).astype(np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, at least 1."""
    if values.max() < len(_BITS16):
        return _BITS16[values]
    return np.maximum(np.searchsorted(_POWERS, values, side="right"), 1).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block and of the end, escaped values)."""
    values = np.ascontiguousarray(values, dtype=U)
    n = len(values)
    if not n:
        return np.zeros(0, U), np.zeros(1, np.int64), np.zeros(0, U)
    blocks = -(-n // BLOCK)
    bits = np.zeros((blocks, BLOCK), np.uint8)  # what a block lacks packs into any word
    bits.reshape(-1)[:n] = _widths(values)
    widest, chosen = bits.copy(), np.full((blocks, BLOCK), 14, np.uint8)
    selector = {int(c): (k, int(w)) for k, (c, w) in enumerate(zip(COUNTS, WIDTHS, strict=True)) if 1 <= k < 14}
    for c in range(2, 61):  # widest: of the next c values of the block
        np.maximum(widest[:, : BLOCK - c + 1], bits[:, c - 1 :], out=widest[:, : BLOCK - c + 1])
        if c in selector:
            k, w = selector[c]
            fits = widest <= w
            chosen[fits] = k  # a denser selector replaces a looser one
            if not fits.any():
                break  # denser ones need narrower values still
    choice = chosen.reshape(-1)[:n].astype(np.int64)
    escaped = values >= _POWERS[60]
    choice[escaped] = 0
    left = np.minimum((np.arange(n) // BLOCK + 1) * BLOCK, n) - np.arange(n)
    step = np.minimum(COUNTS[choice], left)
    pos = np.arange(0, n, BLOCK)
    stop = np.minimum(pos + BLOCK, n)
    firsts = np.zeros(n, dtype=bool)
    while len(pos):  # all blocks advance together
        firsts[pos] = True
        pos = pos + step[pos]
        live = pos < stop
        pos, stop = pos[live], stop[live]
    start = np.flatnonzero(firsts)
    sel, took = choice[start], step[start]
    words = sel.astype(U) << U(60)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == 0:
            words[rows] |= (np.cumsum(escaped)[start[rows]] - 1).astype(U)
            continue
        for j in range(int(COUNTS[s])):
            has = rows[took[rows] > j]
            words[has] |= values[start[has] + j] << U(j * int(WIDTHS[s]))
    offsets = np.searchsorted(start, np.append(np.arange(0, n, BLOCK), n))
    return words, offsets.astype(np.int64), values[escaped]


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, first_block: int = 0, blocks: int | None = None) -> np.ndarray:
    """The n values of encode(), or those of some blocks."""
    last = len(offsets) - 1 if blocks is None else min(first_block + blocks, len(offsets) - 1)
    lo, total = first_block * BLOCK, min(last * BLOCK, n)
    out = np.zeros(max(total - lo, 0), dtype=U)
    if not len(out):
        return out
    words = words[offsets[first_block] : offsets[last]]
    sel = (words >> U(60)).astype(np.int64)
    block = np.searchsorted(offsets[first_block : last + 1] - offsets[first_block], np.arange(len(words)), side="right") - 1
    counts = COUNTS[sel]
    before = np.cumsum(counts) - counts
    starts = offsets[first_block:last] - offsets[first_block]
    at = before - before[starts][block] + block * BLOCK  # a block's last word may be padded
    ends = np.minimum((block + 1) * BLOCK, len(out))
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == 0:
            out[at[rows]] = escapes[(words[rows] & (_POWERS[60] - U(1))).astype(np.int64)]
            continue
        mask = _POWERS[int(WIDTHS[s])] - U(1)
        for j in range(int(COUNTS[s])):
            has = rows[at[rows] + j < ends[rows]]
            out[at[has] + j] = (words[has] >> U(j * int(WIDTHS[s]))) & mask
    return out

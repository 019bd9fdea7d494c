"""Simple-8b word-aligned coding of integer ids, vectorised in numpy.

A 64-bit word has a 4-bit selector on top and 60 bits of payload. Selector s of FIT packs FIT[s] = (count, bits).
An id that needs over 60 bits is an escape: selector ESCAPE, whose payload is the id's place in the raw list at the
end. Ids are coded in blocks of BLOCK ids that start on a word of their own; the table of block offsets lets any
block be decoded alone, and all words of a file be decoded at once, selector by selector.

File image (little-endian): magic, number of ids, of blocks, of words, of raw ids (five u64), then block offsets
(u32, in words, one more than blocks), padded to 8 bytes, words (u64) and raw ids (u64).
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x3142385353444957
BLOCK = 128
ESCAPE = 15
FIT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))


_SMALL = np.array([max(1, i.bit_length()) for i in range(1 << 16)], np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits each id needs (1 at least); 61 for an escape."""
    if len(ids) and ids.max() < len(_SMALL):
        return _SMALL[ids]
    out, left, step = np.ones(len(ids), np.uint8), ids.copy(), 32
    while step:
        high = left >= np.uint64(1 << step)
        if high.any():
            out[high] += step
            left[high] >>= np.uint64(step)
        step //= 2
    return np.minimum(out, 61)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place of the grid, the selector that packs most ids from there on; places after the end need no bits."""
    chosen = np.full(bits.shape, ESCAPE, np.uint8)
    window, held = bits.copy(), 1
    for s in range(len(FIT) - 1, -1, -1):
        count, width = FIT[s]
        while held < count:
            step = min(held, count - held)
            window[:, : BLOCK - step] = np.maximum(window[:, : BLOCK - step], window[:, step:])
            held += step
        chosen[window <= width] = s
    return chosen


def encode(ids: np.ndarray) -> bytes:
    ids = np.ascontiguousarray(ids, np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    flat = np.zeros(blocks * BLOCK + 64, np.uint64)
    flat[:n] = ids
    bits = _bits(flat[: blocks * BLOCK])
    bits[n:] = 0
    chosen = _selectors(bits.reshape(blocks, BLOCK)).reshape(-1)
    counts = np.array([c for c, _ in FIT] + [0, 1])
    first = np.arange(blocks) * BLOCK
    stop, at, starts_here = np.minimum(first + BLOCK, n), first, np.zeros(blocks * BLOCK, bool)
    while len(at):  # all blocks step from word to word together
        starts_here[at] = True
        at = at + counts[chosen[at]]
        inside = at < stop
        at, stop = at[inside], stop[inside]
    start = np.flatnonzero(starts_here)
    sel, pos, block = chosen[start], start % BLOCK, start // BLOCK
    offsets = np.zeros(blocks + 1, np.uint32)
    offsets[1:] = np.cumsum(np.bincount(block, minlength=blocks))
    words = np.zeros(len(block), np.uint64)
    for s, (count, width) in enumerate(FIT):
        at_s = np.flatnonzero(sel == s)
        if len(at_s):
            part, room = np.zeros(len(at_s), np.uint64), BLOCK - pos[at_s]
            for k in range(count):
                part |= np.where(k < room, flat[start[at_s] + k], np.uint64(0)) << np.uint64(k * width)
            words[at_s] = part | np.uint64(s << 60)
    escaped = np.flatnonzero(sel == ESCAPE)
    raw = flat[start[escaped]]
    words[escaped] = np.arange(len(raw), dtype=np.uint64) | np.uint64(ESCAPE << 60)
    head = np.array([MAGIC, n, blocks, len(words), len(raw)], "<u8").tobytes()
    table = offsets.astype("<u4").tobytes()
    return head + table + b"\0" * (-len(table) % 8) + words.astype("<u8").tobytes() + raw.astype("<u8").tobytes()


def decode(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (all by default) of a file image."""
    magic, n, blocks, n_words, n_raw = (int(x) for x in np.frombuffer(image, "<u8", 5))
    if magic != MAGIC:
        raise ValueError("not a Simple-8b file image")
    last = blocks if last is None else min(last, blocks)
    offsets = np.frombuffer(image, "<u4", blocks + 1, 40).astype(np.int64)
    at = 40 + 4 * (blocks + 1)
    at += -at % 8
    raw = np.frombuffer(image, "<u8", n_raw, at + 8 * n_words)
    lo, hi = offsets[first], offsets[last]
    words = np.frombuffer(image, "<u8", hi - lo, at + 8 * lo)
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in FIT] + [0, 1])[sel]
    ends = np.cumsum(counts)
    starts = ends - counts
    # words of one block follow each other; where a block begins anew, its ids begin at a multiple of BLOCK
    which = np.searchsorted(offsets[first : last + 1], np.arange(lo, hi), side="right") - 1
    base = starts[np.minimum(offsets[first:last] - lo, max(0, len(starts) - 1))] if last > first else np.zeros(0, np.int64)
    out = np.zeros((last - first) * BLOCK + 64, np.uint64)
    where = starts - base[which] + which * BLOCK if len(which) else starts
    for s, (count, width) in enumerate(FIT):
        at_s = np.flatnonzero(sel == s)
        if len(at_s):
            mask = np.uint64((1 << width) - 1)
            stop = (which[at_s] + 1) * BLOCK
            for k in range(count):
                pos, value = where[at_s] + k, (words[at_s] >> np.uint64(k * width)) & mask
                fits = pos < stop
                out[pos[fits]] = value[fits]
    escaped = np.flatnonzero(sel == ESCAPE)
    out[where[escaped]] = raw[(words[escaped] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[: min(n, last * BLOCK) - first * BLOCK] if last > first else out[:0]

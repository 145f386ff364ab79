"""Simple-8b word-aligned coding of token ids, vectorised over blocks.

A 64-bit word holds a selector in its top 4 bits and a run of equally wide ids in the other 60.
Selector 0 is the escape: it announces that the next word is one raw 64-bit id too wide for 60 bits.
Ids are cut into blocks of BLOCK; a block starts on a word of its own, and its offset is stored, so
that blocks are coded and decoded side by side and any of them can be read alone.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
#: (ids in a word, bits of each) by selector; 0 is the escape.
LAYOUT = [(0, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([n for n, _ in LAYOUT] + [0])
BITS = np.array([b for _, b in LAYOUT] + [0], np.uint64)


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id (1 for 0)."""
    small = np.frexp(ids.astype(np.float64))[1].astype(np.int16)
    # floats round up near powers of two beyond 53 bits
    large = ids >= np.uint64(1) << np.uint64(52)
    if large.any():
        small[large] = [int(x).bit_length() for x in ids[large].tolist()]
    return np.maximum(small, 1)


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): the coded words and, for each block, where its words begin (one more at the end).

    Each step takes one word from every block: the selector that holds the most of the ids left.
    """
    ids = ids.astype(np.uint64, copy=False)
    n, wide = len(ids), widths(ids)
    blocks = -(-n // block)
    ends = np.minimum((np.arange(blocks) + 1) * block, n)
    at = np.arange(blocks) * block
    # the selector to use at each id: the first in LAYOUT's order whose whole run fits
    best = np.zeros(n, np.int8)
    for s in range(len(LAYOUT) - 1, 0, -1):
        count, bits = LAYOUT[s]
        if count > n:
            continue
        # a run fits if as many ids are too wide before it as before its end
        over = np.cumsum(wide > bits, dtype=np.int32)
        if over[-1] > n - count:
            continue
        fits = np.empty(n - count + 1, bool)
        fits[0] = over[count - 1] == 0
        np.equal(over[count:], over[:-count], out=fits[1:])
        best[: n - count + 1][fits] = s
    pieces, owners = [], []
    live = np.arange(blocks)
    while len(live):
        p, left = at[live], ends[live] - at[live]
        s = best[p].astype(np.int64)
        while (far := COUNTS[s] > left).any():  # a run would cross the block's end: take shorter runs of wider ids
            s[far] += 1
        for sel in np.unique(s).tolist():
            pick = np.flatnonzero(s == sel)
            start, count = p[pick], LAYOUT[sel][0]
            if sel:
                word = np.full(len(pick), sel, np.uint64) << np.uint64(60)
                for j in range(count):
                    word |= ids[start + j] << np.uint64(LAYOUT[sel][1] * j)
                pieces.append(word)
                owners.append(live[pick])
            else:
                count = 1
                pieces += [np.zeros(len(pick), np.uint64), ids[start]]
                owners += [live[pick], live[pick]]
            at[live[pick]] += count
        live = live[at[live] < ends[live]]
    if not pieces:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")  # words of a block were appended in their order
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=blocks))))
    return np.concatenate(pieces)[order], offsets


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of whole coded blocks."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if not selector.all():
        # an escape's next word is raw; a raw word may itself look like an escape
        k, last = 0, len(words)
        maybe = np.flatnonzero(selector == 0)
        k = -2
        for i in maybe.tolist():
            if i == k + 1:
                continue
            k = i
            raw[min(i + 1, last - 1)] = True
    count = np.where(raw, 1, COUNTS[selector])
    starts = np.cumsum(count) - count
    out = np.empty(n, np.uint64)
    out[starts[raw]] = words[raw]
    for sel in range(1, len(LAYOUT)):
        pick = np.flatnonzero((selector == sel) & ~raw)
        if len(pick):
            bits = LAYOUT[sel][1]
            mask, w, at = np.uint64((1 << bits) - 1), words[pick], starts[pick]
            for j in range(LAYOUT[sel][0]):
                out[at + j] = w >> np.uint64(bits * j) & mask
    return out

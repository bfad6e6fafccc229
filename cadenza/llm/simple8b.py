"""Simple-8b word-aligned coding of token ids, in independent blocks.

A 64-bit word holds a 4-bit selector and 60 payload bits: the selector says how many ids the word packs and how wide
each is. Every block of ``BLOCK`` ids starts at a fresh word, whose place is in the block offsets, so a reader decodes
the blocks that it needs, and all words of one selector at once. Ids wider than ``ESCAPE_BITS`` are kept apart, as
(position, value) pairs, and coded as 0 in their word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Fixed values of the format: ids per word and bits per id, by selector. Selectors 0 and 1 are runs of zeros.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
ESCAPE_BITS = 20
_PAD = int(COUNTS.max())


@dataclass
class Coded:
    """Ids in coded form; all arrays are little-endian."""

    n: int
    words: np.ndarray  # uint64
    block_offsets: np.ndarray  # int32: the first word of each block, and the number of words
    escape_positions: np.ndarray  # uint32
    escape_values: np.ndarray  # uint32


def encode(ids: np.ndarray) -> Coded:
    """Pack uint32 ids; greedy, so each word takes as many of the next ids as fit."""
    ids = np.asarray(ids, dtype=np.uint32)
    n = len(ids)
    blocks = -(-n // BLOCK)
    wide = np.flatnonzero(ids >> ESCAPE_BITS)
    padded = np.zeros((blocks, BLOCK), dtype=np.uint32)
    padded.reshape(-1)[:n] = ids
    padded.reshape(-1)[wide] = 0
    grid = np.zeros((blocks, BLOCK + _PAD), dtype=np.uint32)
    grid[:, :BLOCK] = padded
    bits = np.frexp(grid.astype(np.float32))[1].astype(np.uint8)  # exact: ids are under 2^20 here
    best = np.full(bits.shape, 15, dtype=np.uint8)
    most, span = bits.copy(), 1
    for selector in range(14, -1, -1):
        while span < COUNTS[selector]:
            step = min(span, int(COUNTS[selector]) - span)
            np.maximum(most[:, :-step], most[:, step:], out=most[:, :-step])
            span += step
        best[most <= WIDTHS[selector]] = selector
    length = np.full(blocks, BLOCK)
    if blocks:
        length[-1] = n - BLOCK * (blocks - 1)
    at, live, steps = np.zeros(blocks, dtype=np.int64), np.arange(blocks), []
    while len(live):
        where = at[live]
        chosen = best[live, where]
        steps.append((live, where, chosen))
        at[live] = where + COUNTS[chosen]
        live = live[at[live] < length[live]]
    if not steps:
        return Coded(0, np.zeros(0, np.uint64), np.zeros(1, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    block, where, chosen = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(block, kind="stable")
    block, where, chosen = block[order], where[order], chosen[order]
    words = chosen.astype(np.uint64) << np.uint64(60)
    flat = grid.reshape(-1)
    start = block * (BLOCK + _PAD) + where
    for selector in range(2, 16):
        mine = np.flatnonzero(chosen == selector)
        if len(mine):
            value = np.zeros(len(mine), dtype=np.uint64)
            for k in range(int(COUNTS[selector])):
                value |= flat[start[mine] + k].astype(np.uint64) << np.uint64(k * int(WIDTHS[selector]))
            words[mine] |= value
    offsets = np.searchsorted(block, np.arange(blocks + 1)).astype(np.int32)
    return Coded(n, words, offsets, wide.astype(np.uint32), ids[wide])


def decode(coded: Coded, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of blocks ``first_block`` to ``last_block`` (exclusive; the end by default)."""
    blocks = len(coded.block_offsets) - 1
    last_block = blocks if last_block is None else min(last_block, blocks)
    count = max(0, last_block - first_block)
    offsets = coded.block_offsets[first_block : first_block + count + 1].astype(np.int64)
    out = np.zeros((count, BLOCK + _PAD), dtype=np.uint32)
    if count:
        words = coded.words[offsets[0] : offsets[-1]]
        selectors = (words >> np.uint64(60)).astype(np.int64)
        ends = np.cumsum(COUNTS[selectors])
        per_block = np.diff(offsets)
        before = np.repeat((ends - COUNTS[selectors])[offsets[:-1] - offsets[0]], per_block)
        start = ends - COUNTS[selectors] - before + np.repeat(np.arange(count), per_block) * (BLOCK + _PAD)
        flat = out.reshape(-1)
        for selector in range(2, 16):
            mine = np.flatnonzero(selectors == selector)
            mask = np.uint64((1 << int(WIDTHS[selector])) - 1)
            for k in range(int(COUNTS[selector]) if len(mine) else 0):
                flat[start[mine] + k] = (words[mine] >> np.uint64(k * int(WIDTHS[selector]))) & mask
    ids = out[:, :BLOCK].reshape(-1)[: max(0, min(coded.n - first_block * BLOCK, count * BLOCK))]
    inside = (coded.escape_positions >= first_block * BLOCK) & (coded.escape_positions < first_block * BLOCK + len(ids))
    ids[coded.escape_positions[inside] - first_block * BLOCK] = coded.escape_values[inside]
    return ids

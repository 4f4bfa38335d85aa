"""Simple-8b: integers packed into 64-bit words, coded and decoded over whole arrays.

A word holds a selector in its top four bits and 1 to 60 integers of equal width in the other sixty; each word
takes as many of the next integers as fit. An integer of over sixty bits is escaped: a word with the escape
selector, then the integer as a word of its own. Blocks of BLOCK integers start on a word of their own; their
word offsets are stored, so all blocks are walked at once and any block can be read alone.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
# Integers in a word by selector; the width is 60 // count bits.
COUNTS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
_U = np.uint64


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each integer needs."""
    high, low = (values >> _U(32)).astype(np.float64), (values & _U(0xFFFFFFFF)).astype(np.float64)
    upper = np.frexp(high)[1]
    return np.where(upper > 0, upper + 32, np.frexp(low)[1]).astype(np.uint8)


def _fitting(values: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each position the selector of the word that would start there; `left` integers remain in its block."""
    n = len(values)
    left = np.minimum(left, COUNTS[-1]).astype(np.uint8)
    # The most bits of the next `count` values, one step at a time; stops when no position takes more.
    largest = _widths(values)
    selectors, widths, step = np.where(largest > 60, ESCAPE, 0).astype(np.int8), largest.copy(), 1
    for selector, count in enumerate(COUNTS[1:], 1):
        while step < count:
            np.maximum(largest[:n - step], widths[step:], out=largest[:n - step])
            step += 1
        fits = (left >= count) & (largest <= 60 // count)
        if not fits.any():
            break
        selectors[fits] = selector
    return selectors


def encode_many(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word at which each block starts, blocks of each list) of lists that lie one after another in `values`."""
    values, lengths = np.ascontiguousarray(values, _U), np.asarray(lengths, np.int64)
    n = len(values)
    blocks = -(-lengths // BLOCK)
    if not n:
        return np.empty(0, _U), np.empty(0, np.int64), blocks
    # Blocks start anew with each list.
    first = np.repeat(np.cumsum(lengths) - lengths, blocks)
    number = np.arange(len(first)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begins = first + number * BLOCK
    ends = np.append(begins[1:], n)
    selectors = _fitting(values, np.repeat(ends, ends - begins) - np.arange(n))
    takes = np.array([*COUNTS, 0, 1])[selectors]
    # Walk all blocks at once, one word each per step.
    at, last, starts = begins, ends, []
    while len(at):
        starts.append(at)
        at = at + takes[at]
        going = at < last
        at, last = at[going], last[going]
    starts = np.sort(np.concatenate(starts))
    chosen = selectors[starts]
    sizes = 1 + (chosen == ESCAPE)
    places = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), _U)
    for selector in np.unique(chosen):
        here, to = starts[chosen == selector], places[chosen == selector]
        if selector == ESCAPE:
            words[to] = _U(ESCAPE << 60)
            words[to + 1] = values[here]
            continue
        count = COUNTS[selector]
        width = 60 // count
        word = np.full(len(here), int(selector) << 60, _U)
        for i in range(count):
            word |= values[here + i] << _U(i * width)
        words[to] = word
    return words, places[np.searchsorted(starts, begins)], blocks


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset in words of each block) of unsigned integers."""
    return encode_many(values, np.array([len(values)]))[:2]


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The `n` integers that encode() packed."""
    out = np.empty(n, _U)
    if not n:
        return out
    words = np.ascontiguousarray(words, _U)
    selectors = (words >> _U(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    if (selectors == ESCAPE).any():
        # A raw word may look like any other: walk the blocks to tell them apart.
        head[:] = False
        at = offsets.astype(np.int64)
        ends = np.append(at[1:], len(words))
        while len(at):
            head[at] = True
            at = at + 1 + (selectors[at] == ESCAPE)
            at, ends = at[at < ends], ends[at < ends]
    places = np.flatnonzero(head)
    chosen = selectors[places]
    sizes = np.array([*COUNTS, 0, 1])[chosen]
    starts = np.cumsum(sizes) - sizes
    for selector in np.unique(chosen):
        word, to = words[places[chosen == selector]], starts[chosen == selector]
        if selector == ESCAPE:
            out[to] = words[places[chosen == selector] + 1]
            continue
        count = COUNTS[selector]
        width = 60 // count
        mask = _U((1 << width) - 1)
        for i in range(count):
            out[to + i] = (word >> _U(i * width)) & mask
    return out

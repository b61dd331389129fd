"""Substring dedup of words: a compressed FM-index for each shard.

The Burrows-Wheeler transform of a shard is kept in a wavelet matrix, whose levels are
packed bits with block counts.  Windows are streamed through it from their last word
to their first; the interval that is left after W steps has all occurrences of the
window in the shard.  A window whose interval shrinks to one suffix is unique and its
search ends.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from palimpsest.llm.repeats import Kind, without_repeats

#: Consecutive words that make a window.
WINDOW = 20


def _suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more, by doubling."""
    _, rank = np.unique(text, return_inverse=True)
    span = 1
    while span < depth:
        after = np.zeros_like(rank)
        after[:-span] = rank[span:] + 1
        _, rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)
        span *= 2
    return np.argsort(rank, kind="stable")


class WaveletMatrix:
    """Rank queries over a sequence of numbers below ``size``, for many positions at once."""

    def __init__(self, values: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.append(packed, np.zeros(8 - len(packed) % 8 + 8, dtype=np.uint8))
            blocks = packed[: len(packed) // 8 * 8].view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)])
            self.levels.append((blocks, before, int(len(values) - bit.sum())))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        every = np.arange(size)
        self.start = self._descend(every, np.zeros(size, dtype=np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (blocks, before, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            word = at >> 6
            below = blocks[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = before[word] + np.bitwise_count(below)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._descend(symbols, at) - self.start[symbols]


class FMIndex:
    def __init__(self, text: np.ndarray, depth: int):
        order = _suffix_order(text, depth)
        size = int(text.max()) + 1
        self.n = len(text)
        self.transform = WaveletMatrix(text[order - 1], size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many intervals."""
        base = self.smaller[symbols]
        return base + self.transform.rank(symbols, lo), base + self.transform.rank(symbols, hi)


def window_classes(text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For each window the first suffix of its interval, or -1 if it occurs once."""
    index = FMIndex(text, window)
    found = np.full(len(starts), -1, dtype=np.int64)
    active = np.arange(len(starts))
    lo, hi = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), index.n, dtype=np.int64)
    for step in range(window - 1, -1, -1):
        lo, hi = index.extend(text[starts[active] + step], lo, hi)
        several = hi - lo > 1
        active, lo, hi = active[several], lo[several], hi[several]
    found[active] = lo
    return found


KIND = Kind(words=True, window=WINDOW, gram=6, shard_units=800_000, index=window_classes)


def drop_repeated_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document without the words covered by a window of ``WINDOW`` words that also starts earlier.

    Returns doc_id, n_words, n_removed, n_spans, kept_sha256 and kept (the words left,
    joined by one space); ``repeats.without_repeats`` says what is earlier, and what
    becomes of nulls, short texts and repeated rows.  An empty table gives an empty one.
    """
    done = without_repeats(docs, KIND, id_column, text_column)
    return done.withColumn("kept", done["kept"].cast("string")).withColumnRenamed("n_units", "n_words")

"""Suffix-array dedup of bytes by the difference-cover algorithm.

Spark deals the candidate text out by content, so that equal strings meet; in every
shard the suffix array is built by difference cover modulo 3: the triples at two of
three positions are sorted and named, the names' suffixes are sorted by recursion, the
remaining suffixes are merged in, and adjacent suffixes are compared byte by byte.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from palimpsest.llm.repeats import Kind, without_repeats

#: Bytes of a string whose repetition is removed.
WINDOW = 100


#: Keys are below this.
KEYS = 1 << 63


def _joint(high: np.ndarray, low: np.ndarray, size: int) -> np.ndarray:
    """Numbers in the order of the pairs, ``low`` being below ``size``: only of one call's pairs, if ``high`` must be ranked."""
    if len(high) and (int(high.max()) + 1) * size > KEYS:
        high = np.unique(high, return_inverse=True)[1].astype(np.int64)
        if len(high) * size > KEYS:
            raise OverflowError(f"{len(high)} suffixes with {size} names do not fit 64-bit keys")
    return high * size + low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of numbers over 0, however many; keys that 64 bits cannot hold are ranked in steps."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int64)
    s = np.concatenate([text, np.zeros(3, dtype=np.int64)])
    size = int(text.max()) + 1
    # Positions 1 and 2 modulo 3; where n is 1 modulo 3, one more keeps the two halves apart.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triples = _joint(_joint(s[sample], s[sample + 1], size), s[sample + 2], size)
    distinct, names = np.unique(triples, return_inverse=True)
    if len(distinct) < len(sample):
        order = suffix_array(names.astype(np.int64) + 1)
    else:
        # The names are the order already.
        order = np.empty(len(sample), dtype=np.int64)
        order[names] = np.arange(len(sample))
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]

    zero = np.arange(0, n, 3)
    by_one = lambda i: _joint(s[i], rank[i + 1], n + 4)
    by_two = lambda i: _joint(_joint(s[i], s[i + 1], size), rank[i + 2], n + 4)
    zero = zero[np.argsort(by_one(zero))]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    # Sampled suffixes before each of the rest: those at 1 compare by one symbol and a name, those at 2 by two.
    one, two = by_one(np.concatenate([first, zero])), by_two(np.concatenate([second, zero]))
    before = np.searchsorted(one[: len(first)], one[len(first) :]) + np.searchsorted(two[: len(second)], two[len(second) :])
    merged = np.empty(n, dtype=np.int64)
    place = before + np.arange(len(zero))
    merged[place] = zero
    rest = np.ones(n, dtype=bool)
    rest[place] = False
    merged[rest] = sampled
    return merged


def window_classes(text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For each window the number of its run of equal prefixes in the suffix array, or -1 if it occurs once."""
    is_window = np.zeros(len(text), dtype=bool)
    is_window[starts] = True
    order = suffix_array(text + 1)
    order = order[is_window[order]]
    equal = np.zeros(len(order) + 1, dtype=bool)
    narrow = np.uint8 if len(text) and text.max() < 256 else np.uint16
    strings = np.lib.stride_tricks.sliding_window_view(text.astype(narrow), window)
    for lo in range(1, len(order), 20_000):
        hi = min(lo + 20_000, len(order))
        # Neighbours that differ do so in their last symbols as a rule: those that do not are compared whole.
        ends = strings[order[lo - 1 : hi], -8:]
        alike = lo + np.flatnonzero((ends[1:] == ends[:-1]).all(axis=1))
        equal[alike] = (strings[order[alike]] == strings[order[alike - 1]]).all(axis=1)
    run = np.cumsum(~equal[:-1])
    run[~equal[:-1] & ~equal[1:]] = -1
    found = np.full(len(text), -1, dtype=np.int64)
    found[order] = run
    return found[starts]


KIND = Kind(words=False, window=WINDOW, gram=24, shard_units=1_000_000, index=window_classes)


def drop_repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document without the bytes covered by a string of ``WINDOW`` bytes that also starts earlier.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and
    kept (the bytes left, concatenated); ``repeats.without_repeats`` says what is
    earlier, and what becomes of nulls, short texts and repeated rows.  An empty table
    gives an empty one.
    """
    return without_repeats(docs, KIND, id_column, text_column).withColumnRenamed("n_units", "n_bytes")

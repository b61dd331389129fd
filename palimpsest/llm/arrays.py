"""Arrow batches of texts as numpy arrays: words, their hashes, groups of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a single longer text is one part.
PART = 1 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that separate terms: all ASCII but digits and letters.
NO_TERM = np.ones(256, dtype=bool)
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        factors = np.full(max(n, PART + 1), base, dtype=np.uint64)
        factors[0] = 1
        known = np.cumprod(factors, dtype=np.uint64)
        if len(known) <= 4 * PART:
            _powers[name] = known
    return known[:n]


def text_parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes, and the rows' offsets in them; about ``PART`` bytes each, no text divided."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PART, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(
    data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data``, and for each text the index of its first word (and the end)."""
    inside = ~separator[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def as_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices of ``data``, which do not overlap, as binary strings."""
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    kept = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word, the same for the same bytes."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]
) -> Iterator[pa.RecordBatch]:
    """``work`` on whole groups of rows with equal keys, which come one after another.

    What ``work`` gets are several groups at a time, as they fill batches; it finds
    their bounds with ``bounds``.
    """
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        edges = bounds(table, keys)
        first = tuple(table.column(k)[0].as_py() for k in keys)
        if waiting and first != last:
            yield from work(pa.Table.from_batches(waiting))
            waiting = []
        last_start = int(edges[-2])
        if last_start > 0:
            yield from work(pa.Table.from_batches([*waiting, batch.slice(0, last_start)]))
            waiting = [batch.slice(last_start)]
        else:
            waiting.append(batch)
        last = tuple(table.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if waiting:
        yield from work(pa.Table.from_batches(waiting))


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of equal keys begin, and the end; keys are whole numbers without nulls."""
    changed = np.zeros(table.num_rows + 1, dtype=bool)
    changed[0] = changed[-1] = True
    for k in keys:
        values = table.column(k).to_numpy()
        changed[1:-1] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)

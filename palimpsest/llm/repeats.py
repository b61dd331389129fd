"""Removing what already stands earlier in a table, window by window; shared by two operators.

A window is a run of W units (words or bytes) of one document.  Every window has an
anchor, the smallest hash of its grams; equal windows have equal anchors.  So the
table is first reduced to windows whose anchor occurs again, and these are dealt out
by anchor: equal windows always meet in one shard, which an index then searches.

1. ``_anchors``: anchors of each document; a grouping finds those that occur twice.
2. ``_pieces``: runs of windows with such an anchor, with the text they lie in.
3. ``_resolve``: shards of pieces; an index says which windows occur earlier.
4. ``_removed``: runs of covered units per document, and what is left.

Hot anchors: equal pieces within a batch are combined before the exchange, so a key
has few rows for each batch, however many documents have it; anchors whose different
pieces of all batches together would fill a shard are dealt out window by window, by the
hash of the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrays import _BASE, _INVERSE, _power, bounds, groups, mix, text_parts, word_hashes, words_of
from palimpsest.llm.common import texts
from palimpsest.session import Workspace

#: Windows of a piece, at most; longer runs (of periodic text) are several pieces.
RUN = 256
#: Bytes of pieces that are made and handed on at a time; a single longer piece is one step.
BODIES = 1 << 22
_NULL_ID = -(1 << 63)

#: Given the shard's units, and where its windows start, the class of every window:
#: equal for equal windows, -1 for a window that occurs once.
Index = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


@dataclass(frozen=True)
class Kind:
    """What a unit is, how many make a window and a gram, and how shards are searched.

    ``shard_units`` is what a shard holds at most: half of it from several anchors, all of it from one.
    """

    words: bool
    window: int
    gram: int
    shard_units: int
    index: Index

    @property
    def grams(self) -> int:
        return self.window - self.gram + 1


@dataclass
class _Part:
    first: int
    rows: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: Index of each row's first unit, and the end.
    at: np.ndarray
    units: np.ndarray

    def body(self, lo: int, hi: int) -> bytes:
        return self.data[self.starts[lo] : self.ends[hi - 1]].tobytes()


def _parts(kind: Kind, column: pa.Array, hashed: bool = True) -> Iterator[_Part]:
    """Units of the texts; words are parted by one space each, whatever parted them before.

    The units' numbers are left out where only their places are asked for (``hashed``).
    """
    none = np.zeros(0, dtype=np.uint64)
    for first, end, data, offsets in text_parts(column):
        if kind.words:
            starts, ends, at = words_of(data, offsets)
            units = word_hashes(data, starts, ends) if hashed else none
            keep = np.zeros(len(data) + 1, dtype=bool)
            depth = np.zeros(len(data) + 1, dtype=np.int8)
            np.add.at(depth, starts, 1)
            np.add.at(depth, ends, -1)
            inside = np.cumsum(depth, dtype=np.int8)[:-1].astype(bool)
            keep[:-1] = inside
            keep[ends] = True
            place = np.cumsum(keep) - keep
            spaced = np.where(inside, data, np.uint8(0x20))[keep[:-1]]
            yield _Part(first, end - first, spaced, place[starts], place[starts] + (ends - starts), at, units)
        else:
            n = np.arange(len(data), dtype=np.int64)
            yield _Part(first, end - first, data, n, n + 1, offsets, data.astype(np.uint64) + np.uint64(1) if hashed else none)


def _hashes(units: np.ndarray, length: int) -> np.ndarray:
    """64 bits for every run of ``length`` units."""
    n = len(units)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(units * _power("up", _BASE, n), out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * _power("down", _INVERSE, n + 1)[: n - length + 1])


def _spans(units: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64 bits for every given run of units."""
    n = len(units)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(units * _power("up", _BASE, n), out=sums[1:])
    return mix((sums[first + length] - sums[first]) * _power("down", _INVERSE, n + 1)[first] + length.astype(np.uint64))


def _runs(kind: Kind, part: _Part) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows and anchor of every run of windows with one
    anchor, and whether the anchor stands in it twice: only then can it repeat itself."""
    gram = least = _hashes(part.units, kind.gram)
    span = 1
    while span * 2 <= kind.grams and len(least) > span:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = kind.grams - span
    if rest and len(least) > rest:
        least = np.minimum(least[:-rest], least[rest:])
    n = len(part.units) - kind.window + 1
    empty = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(bool)
    least = least[:n]
    end = part.at[1:] - kind.window + 1
    long = end > part.at[:-1]
    open_ = np.zeros(len(part.units) + 2, dtype=np.int8)
    np.add.at(open_, part.at[:-1][long], 1)
    np.add.at(open_, end[long], -1)
    valid = np.cumsum(open_, dtype=np.int8)[:n].astype(bool)
    begins = valid.copy()
    begins[1:] &= least[1:] != least[:-1]
    begins[part.at[:-1][long]] = True
    first = np.flatnonzero(begins)
    row = np.searchsorted(part.at, first, side="right") - 1
    last = np.minimum(np.append(first[1:], n), end[row])
    count = last - first
    if len(count) and count.max() > RUN:
        times = -(-count // RUN)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, first, last = np.repeat(row, times), np.repeat(first, times) + nth * RUN, np.repeat(last, times)
        count = np.minimum(last - first, RUN)
    anchor = least[first]
    inner = np.zeros(len(first), dtype=bool)
    # Some runs at a time: the spans of neighbours overlap.
    for lo in range(0, len(first), 8192):
        some = slice(lo, lo + 8192)
        span = count[some] + kind.grams - 1
        at = np.cumsum(span) - span
        place = np.arange(span.sum()) + np.repeat(first[some] - at, span)
        inner[some] = np.add.reduceat(gram[place] == np.repeat(anchor[some], span), at, dtype=np.int64) > 1
    return row, first, count, anchor, inner


def _anchors(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(v, salt, d, known, units): each anchor once a batch (salt 0), and where it is known to
    repeat, because the batch has it twice, each of its documents (salt not 0).

    ``units`` is what a shard would hold of the batch's different pieces with the anchor.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("d").to_numpy()
            found_v, found_d, found_n, found_u, found_w = [], [], [], [], []
            for part in _parts(kind, batch.column("text")):
                row, first, count, v, inner = _runs(kind, part)
                found_u.append(count + kind.window)
                found_w.append(_spans(part.units, first, count + (kind.window - 1)))
                found_v.append(v)
                found_d.append(ids[part.first + row])
                found_n.append(1 + inner)
            if not found_v:
                continue
            v, d, n, u, w = map(np.concatenate, (found_v, found_d, found_n, found_u, found_w))
            order = np.lexsort((d, v))
            v, d, n, u, w = v[order].view(np.int64), d[order], n[order], u[order], w[order]
            first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, dtype=np.int64)
            total = np.add.reduceat(n, first) if len(v) else n
            again = np.repeat(total > 1, np.diff(np.append(first, len(v))))
            # Equal pieces of an anchor count once.
            several = np.flatnonzero(again)
            several = several[np.lexsort((w[several], v[several]))]
            same = (v[several][1:] == v[several][:-1]) & (w[several][1:] == w[several][:-1])
            u[several[1:][same]] = 0
            units = np.add.reduceat(u, first) if len(v) else u
            fresh = again & np.append(True, (v[1:] != v[:-1]) | (d[1:] != d[:-1]))[: len(v)]
            direct_v, direct_d = v[fresh], d[fresh]
            salt = mix(direct_d.view(np.uint64)).view(np.int64) | 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([v[first], direct_v])),
                    pa.array(np.concatenate([np.zeros(len(first), dtype=np.int64), salt])),
                    pa.array(np.concatenate([d[first], direct_d])),
                    pa.array(np.concatenate([total > 1, np.ones(len(direct_v), dtype=bool)])),
                    pa.array(np.concatenate([units, np.zeros(len(direct_v), dtype=np.int64)])),
                ],
                names=["v", "salt", "d", "known", "units"],
            )

    return work


def _repeated(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(d, v, hot): documents and their repeated anchors; for a hot anchor one row more."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        edges = bounds(table, ["v", "salt"])
        v, salt, d, known = (table.column(c).to_numpy() for c in ("v", "salt", "d", "known"))
        size = np.diff(edges)
        any_known = np.add.reduceat(known.astype(np.int64), edges[:-1]) > 0
        again = np.repeat((size > 1) | any_known, size)
        # Known ones were marked where they were found.
        marked = again & (~known | (salt != 0))
        units = np.add.reduceat(table.column("units").to_numpy(), edges[:-1])
        # Each row stands for a window of units at least, so a key that is not hot has few rows as well.
        hot = edges[:-1][units > kind.shard_units]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([d[marked], d[hot]])),
                pa.array(np.concatenate([v[marked], v[hot]])),
                pa.array(np.concatenate([np.zeros(marked.sum(), dtype=bool), np.ones(len(hot), dtype=bool)])),
            ],
            names=["d", "v", "hot"],
        )

    return lambda batches: groups(batches, ["v", "salt"], work)


def _pieces(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(v, salt, d, th, start, n, inner, body): pieces; without a body, windows known to stand earlier.

    Equal pieces of a batch are found by their hashes and compared in the text, so that only the bodies
    that are handed on are made, ``BODIES`` at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("d").to_numpy(), batch.column("th").to_numpy()
            found: list[tuple[np.ndarray, ...]] = []
            pages: list[bytes] = []
            length = 0
            for part in _parts(kind, batch.column("text")):
                row, first, count, v, twice = _runs(kind, part)
                marks = batch.column("marks").slice(part.first, part.rows)
                sizes = np.diff(np.asarray(marks.offsets))
                flat = marks.flatten()
                owner = np.repeat(np.arange(part.rows, dtype=np.uint64), sizes)
                marked = flat.field("v").to_numpy().view(np.uint64)
                hot = flat.field("hot").to_numpy(zero_copy_only=False)
                joint = lambda r, x: mix(x + mix(r.astype(np.uint64) + np.uint64(1)))
                own, all_marks = joint(row, v), joint(owner, marked)
                cold = np.flatnonzero(np.isin(own, all_marks[~hot]))
                warm = np.flatnonzero(np.isin(own, all_marks[hot])) if hot.any() else cold[:0]
                single = np.repeat(first[warm], count[warm]) + (
                    np.arange(count[warm].sum()) - np.repeat(np.cumsum(count[warm]) - count[warm], count[warm])
                )
                if not len(cold) and not len(single):
                    continue
                whole = _hashes(part.units, kind.window)[single] if len(single) else v[:0]
                r = np.concatenate([row[cold], np.repeat(row[warm], count[warm])])
                f = np.concatenate([first[cold], single])
                c = np.concatenate([count[cold], np.ones(len(single), dtype=np.int64)])
                spans = _spans(part.units, first[cold], count[cold] + (kind.window - 1))
                inner = np.concatenate([twice[cold], np.zeros(len(single), dtype=bool)])
                lo, hi = length + part.starts[f], length + part.ends[f + c + kind.window - 2]
                found.append((part.first + r, f - part.at[r], c, np.concatenate([v[cold], whole]), np.concatenate([spans, whole]), inner, lo, hi))
                pages.append(part.data.tobytes())
                length += len(part.data)
            if not found:
                continue
            row, start, count, key, span, inner, lo, hi = map(np.concatenate, zip(*found))
            text = b"".join(pages)
            del found, pages
            d, th = ids[row], hashes[row]
            # Pieces with one hash, the earliest first; one that is not the same bytes after all has a body of its own.
            order = np.lexsort((start, th, d, span))
            fresh = np.append(True, span[order][1:] != span[order][:-1])
            leader = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
            later = np.zeros(len(order), dtype=bool)
            again, of = order[~fresh], leader[~fresh]
            for a in range(0, len(again), 1 << 16):
                some, first = again[a : a + (1 << 16)], of[a : a + (1 << 16)]
                pairs = zip(lo[some].tolist(), hi[some].tolist(), lo[first].tolist(), hi[first].tolist())
                later[some] = [text[i:j] == text[x:y] for i, j, x, y in pairs]
            salt = np.where(later, mix(d.view(np.uint64) + start.astype(np.uint64)).view(np.int64) | 1, 0)
            # A row without a body counts as well, so that no step has too many of them.
            step = np.cumsum(np.where(later, 0, hi - lo) + 64) // BODIES
            edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
            for a, b in zip(edges[:-1], edges[1:]):
                bodies = [None if x else text[y:z] for x, y, z in zip(later[a:b].tolist(), lo[a:b].tolist(), hi[a:b].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[a:b].view(np.int64)), pa.array(salt[a:b]), pa.array(d[a:b]), pa.array(th[a:b]),
                        pa.array(start[a:b].astype(np.int64)), pa.array(count[a:b].astype(np.int64)),
                        pa.array(inner[a:b]), pa.array(bodies, pa.binary()),
                    ],
                    names=["v", "salt", "d", "th", "start", "n", "inner", "body"],
                )

    return work


def _resolve(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(d, th, start, n): units that lie in a window that stands earlier."""

    def covered(d: np.ndarray, th: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(x.astype(np.int64)) for x in (d, th, start, n + (kind.window - 1))]
        return pa.RecordBatch.from_arrays(columns, names=["d", "th", "start", "n"])

    def search(shard: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        """Index the pieces of a shard and look every window of theirs up in it."""
        column = pa.array([p[4] for p in shard], pa.large_binary())
        values = []
        for part in _parts(kind, column):
            values.append((part.units, part.at))
        units, offsets = [], [0]
        for u, part_at in values:
            for lo, hi in zip(part_at[:-1], part_at[1:]):
                units.append(u[lo:hi])
                offsets.append(offsets[-1] + int(hi - lo) + 1)
        symbols, local = np.unique(np.concatenate(units), return_inverse=True)
        text = np.zeros(offsets[-1], dtype=np.int64)
        taken = 0
        for u, lo in zip(units, offsets):
            text[lo : lo + len(u)] = local[taken : taken + len(u)] + 1
            taken += len(u)
        n = np.array([p[3] for p in shard])
        piece = np.repeat(np.arange(len(shard)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = np.array(offsets[:-1])[piece] + within
        same = kind.index(text, window, kind.window)
        d, th, start = (np.array([p[k] for p in shard], dtype=np.int64) for k in range(3))
        wd, wth, wstart = d[piece], th[piece], start[piece] + within
        order = np.lexsort((wstart, wth, wd, same))
        same = same[order]
        later = (same >= 0) & np.append(False, same[1:] == same[:-1])
        hit = order[later]
        # Windows that overlap or touch are one stretch: else there is a row for every unit.
        hit = hit[np.lexsort((wstart[hit], wth[hit], wd[hit]))]
        d, th, start = wd[hit], wth[hit], wstart[hit]
        apart = (d[1:] != d[:-1]) | (th[1:] != th[:-1]) | (start[1:] - start[:-1] > kind.window)
        edges = np.flatnonzero(np.concatenate([[True], apart, [True]])) if len(hit) else np.zeros(1, dtype=np.int64)
        first, last = edges[:-1], edges[1:] - 1
        return covered(d[first], th[first], start[first], start[last] - start[first] + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, int, int, int, bytes]] = []
        held = 0

        def step(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal shard, held
            edges = bounds(table, ["v", "salt"])
            d, th, start, n = (table.column(c).to_numpy() for c in ("d", "th", "start", "n"))
            known = table.column("body").is_null().to_numpy()
            inner = table.column("inner").to_numpy()
            if known.any():
                yield covered(d[known], th[known], start[known], n[known])
            bodies = table.column("body")
            equal: list[int] = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if hi - lo == 1 and (known[lo] or not inner[lo]):
                    continue
                distinct: dict[bytes, int] = {}
                for i, body in zip(range(lo, hi), bodies.slice(lo, hi - lo).to_pylist()):
                    if body in distinct:
                        equal.append(i)
                    elif body is not None:
                        distinct[body] = i
                if len(distinct) > 1 or any(inner[i] for i in distinct.values()):
                    own = sum(int(n[i]) + kind.window for i in distinct.values())
                    if shard and held + own > kind.shard_units:
                        yield search(shard)
                        shard, held = [], 0
                    shard += [(int(d[i]), int(th[i]), int(start[i]), int(n[i]), body) for body, i in distinct.items()]
                    held += own
                    if held > kind.shard_units // 2:
                        yield search(shard)
                        shard, held = [], 0
            if equal:
                yield covered(d[equal], th[equal], start[equal], n[equal])

        yield from groups(batches, ["v", "salt"], step)
        if shard:
            yield search(shard)

    return work


def _joined(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The stretches that runs cover, in order; runs that overlap or touch are one stretch."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    apart = np.flatnonzero(starts[1:] > ends[:-1])
    return list(zip(starts[np.append(0, apart + 1)].tolist(), ends[np.append(apart, len(ends) - 1)].tolist()))


def _removed(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of each document, and what is left: words joined by one space, or bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(kind, batch.column("text"), hashed=False):
                n = np.diff(part.at)
                runs = batch.column("runs").slice(part.first, part.rows)
                edges = np.append(0, np.cumsum(runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
                starts, sizes = (runs.flatten().field(c).to_numpy() for c in ("start", "n"))
                removed, spans, kept = [], [], []
                for row in range(part.rows):
                    lo, hi = int(part.at[row]), int(part.at[row + 1])
                    own = slice(edges[row], edges[row + 1])
                    if own.start < own.stop:
                        gone = _joined(starts[own], starts[own] + sizes[own])
                        spans.append(len(gone))
                        removed.append(sum(end - first for first, end in gone))
                        left = zip([0] + [end for _, end in gone], [first for first, _ in gone] + [hi - lo])
                        kept.append((b" " if kind.words else b"").join(part.body(lo + x, lo + y) for x, y in left if x < y))
                    else:
                        removed.append(0), spans.append(0)
                        kept.append(part.body(lo, hi) if hi > lo else b"")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("d").slice(part.first, part.rows), batch.column("th").slice(part.first, part.rows),
                        pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()),
                    ],
                    names=["d", "th", "n_units", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return work


def without_repeats(docs: DataFrame, kind: Kind, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256 and kept (bytes) of every document.

    Earlier means a smaller id, or a smaller start in the same document; a null id is
    the smallest; rows with one id and different texts follow a hash of their text;
    rows equal in id and text are one document, so each has the same result.  A null
    text is empty; texts shorter than a window are kept whole.
    """
    space = Workspace(docs.sparkSession)
    plain = texts(docs, id_column, text_column).select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("d"), F.xxhash64("text").alias("th"), "text"
    )
    marks = space.written(
        plain.select("d", "text")
        .mapInArrow(_anchors(kind), "v bigint, salt bigint, d bigint, known boolean, units bigint")
        .repartition("v", "salt")
        .sortWithinPartitions("v", "salt")
        .mapInArrow(_repeated(kind), "d bigint, v bigint, hot boolean")
    )
    hot = marks.filter("hot").select("v", F.lit(True).alias("is_hot")).distinct()
    per_document = (
        marks.filter("not hot").select("d", "v").join(hot, "v", "left")
        .groupBy("d").agg(F.collect_set(F.struct("v", F.coalesce("is_hot", F.lit(False)).alias("hot"))).alias("marks"))
    )
    runs = space.written(
        plain.join(per_document, "d")
        .mapInArrow(_pieces(kind), "v bigint, salt bigint, d bigint, th bigint, start bigint, n bigint, inner boolean, body binary")
        .repartition("v", "salt")
        .sortWithinPartitions("v", "salt", "d", "th", "start")
        .mapInArrow(_resolve(kind), "d bigint, th bigint, start bigint, n bigint")
    )
    gone = runs.groupBy("d", "th").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    done = (
        plain.join(gone, ["d", "th"], "left")
        .select("d", "th", "text", "runs")
        .mapInArrow(
            _removed(kind),
            "d bigint, th bigint, n_units bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary",
        )
    )
    doc_id = F.when(F.col("d") != _NULL_ID, F.col("d")).alias("doc_id")
    return done.select(doc_id, "n_units", "n_removed", "n_spans", "kept_sha256", "kept")

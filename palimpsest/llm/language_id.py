"""Language identification by unigram models of pieces, summed over all segmentations.

The pieces are those of a public byte-level vocabulary, which is fixed; what is learned is
a probability for each piece and language.  A word has the probability of all its
segmentations together, which the forward algorithm adds up, and a text that of its words.
Learning counts pieces over all segmentations too, by their share in the sum, a few times.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrays import as_strings, text_parts
from palimpsest.session import Workspace

#: What is said of a text without a letter, or if no language was learned.
UNKNOWN = "und"
#: Words are cut into stretches of so many bytes, so that sums stay within a double's range.
STRETCH = 32
#: Scores of words that a task remembers, and words that are segmented at a time.
REMEMBERED, AT_ONCE = 1 << 17, 1 << 15


@dataclass(frozen=True)
class Fit:
    """What learning is bounded by: different whole texts of a language, rounds, the share of a
    count that every piece has in advance, and languages (more raise an error)."""

    documents: int = 2000
    rounds: int = 3
    smoothing: float = 0.1
    languages: int = 512


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    pieces: tuple[bytes, ...]
    #: Probabilities of pieces (rows) by language.
    chances: np.ndarray
    #: Share of each language among the documents learned from.
    shares: np.ndarray


def letter_pieces(path: str) -> tuple[bytes, ...]:
    """The pieces of a vocabulary (a base64 piece and its rank on each line) that can stand in a lower-case word
    with a space before it; every single byte is one."""
    inside = {*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)}
    pieces = {bytes([b]) for b in (0x20, *inside)}
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0])
            own = piece.removeprefix(b" ")
            if own and len(piece) <= STRETCH and inside.issuperset(own):
                pieces.add(piece)
    return tuple(sorted(pieces))


class _Trie:
    """Pieces as a table of transitions; node 0 is nowhere, node 1 the root."""

    def __init__(self, pieces: Sequence[bytes]):
        used = sorted({b for p in pieces for b in p})
        self.kind = np.zeros(256, dtype=np.int32)
        self.kind[used] = np.arange(1, len(used) + 1)
        children: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i, piece in enumerate(pieces):
            node = 1
            for b in piece:
                node = children.setdefault((node, b), len(children) + 2)
            ends[node] = i
        self.next = np.zeros((len(children) + 2, len(used) + 1), dtype=np.int32)
        at = np.array(list(children), dtype=np.int64).reshape(-1, 2)
        self.next[at[:, 0], self.kind[at[:, 1]]] = np.array(list(children.values()), dtype=np.int32)
        self.piece = np.full(len(children) + 2, -1, dtype=np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.longest = max(map(len, pieces))


@cache
def _trie(pieces: tuple[bytes, ...]) -> _Trie:
    return _Trie(pieces)


class Lattice:
    """All pieces of some words: edges between the positions of their stretches."""

    def __init__(self, words: pa.Array, trie: _Trie):
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
        flat = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets[:-1] - offsets[0] + np.arange(len(words))
        sizes = np.diff(offsets) + 1
        data = np.full(len(flat) + len(words), 0x20, dtype=np.uint8)
        own = np.ones(len(data), dtype=bool)
        own[starts] = False
        data[own] = flat
        many = -(-sizes // STRETCH)
        self.first = np.concatenate([[0], np.cumsum(many)])[:-1]
        nth = np.arange(many.sum()) - np.repeat(self.first, many)
        begin = np.repeat(starts, many) + STRETCH * nth
        length = np.minimum(STRETCH, np.repeat(sizes, many) - STRETCH * nth)
        stretch = np.repeat(np.arange(len(begin)), length)
        end = (begin + length)[stretch]
        # A stretch of n bytes has n + 1 positions.
        self.source, self.sink = begin + np.arange(len(begin)), begin + length + np.arange(len(begin))
        self.positions = len(data) + len(begin)
        at, node = np.arange(len(data)), np.ones(len(data), dtype=np.int32)
        found = []
        for n in range(1, trie.longest + 1):
            node = trie.next[node, trie.kind[data[at + n - 1]]]
            alive = node > 0
            at, node = at[alive], node[alive]
            piece = trie.piece[node]
            whole = piece >= 0
            found.append((at[whole], np.full(whole.sum(), n), piece[whole]))
            more = at + n < end[at]
            at, node = at[more], node[more]
            if not len(at):
                break
        start, n, self.piece = (np.concatenate(x) for x in zip(*found))
        self.tail = start + stretch[start]
        self.head = self.tail + n
        self.depth = start - begin[stretch[start]]
        self.reach = self.depth + n

    def _sums(self, chances: np.ndarray, edges_from: np.ndarray, edges_to: np.ndarray, step: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Sums of products along all paths from the known positions, step after step."""
        total = np.zeros((self.positions, chances.shape[1]))
        total[known] = 1
        order = np.lexsort((edges_to, step))
        edges_from, edges_to, step, piece = edges_from[order], edges_to[order], step[order], self.piece[order]
        cuts = np.flatnonzero(np.diff(step, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(step)]):
            groups = np.flatnonzero(np.diff(edges_to[lo:hi], prepend=-1))
            total[edges_to[lo:hi][groups]] = np.add.reduceat(total[edges_from[lo:hi]] * chances[piece[lo:hi]], groups, axis=0)
        return total

    def forward(self, chances: np.ndarray) -> np.ndarray:
        return self._sums(chances, self.tail, self.head, self.reach, self.source)

    def backward(self, chances: np.ndarray) -> np.ndarray:
        return self._sums(chances, self.head, self.tail, STRETCH - self.depth, self.sink)

    def logs(self, chances: np.ndarray) -> np.ndarray:
        """For each word the logarithm of its probability by language."""
        return np.add.reduceat(np.log(self.forward(chances)[self.sink]), self.first, axis=0)

    def counts(self, chances: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected number of each piece in the words, each ``times`` over, for one language."""
        ahead, behind = self.forward(chances)[:, 0], self.backward(chances)[:, 0]
        weight = np.zeros(self.positions)
        weight[self.source] = np.repeat(times, np.diff(self.first, append=len(self.source))) / ahead[self.sink]
        # A stretch's weight stands at its source, ``depth`` before an edge's tail.
        share = ahead[self.tail] * chances[self.piece, 0] * behind[self.head] * weight[self.tail - self.depth]
        return np.bincount(self.piece, weights=share, minlength=len(chances))


@cache
def _kinds() -> np.ndarray:
    """For each code point 1 if it is a letter, 2 if a mark, which belongs to the word it stands in."""
    return np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], dtype=np.uint8)


def _words(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """For parts of a column: first row, the words in lower case, the rows' offsets in them, and which rows have a letter."""
    for first, end, data, offsets in text_parts(pc.utf8_lower(column)):
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        kind = _kinds()[points]
        if len(points) < len(data):
            kind = np.repeat(kind, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        inside = kind > 0
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        starts = np.flatnonzero(inside & (~np.concatenate([[False], inside])[:-1] | cut[:-1]))
        ends = np.flatnonzero(inside & (~np.concatenate([inside, [False]])[1:] | cut[1:])) + 1
        lettered = np.concatenate([[0], np.cumsum(kind == 1)])[offsets]
        yield first, as_strings(data, starts, ends), np.searchsorted(starts, offsets), np.diff(lettered) > 0


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts to their different words, with the number of times, text by text or for some together."""
    for batch in batches:
        for first, words, at, _ in _words(batch.column("text")):
            rows = pa.array(np.repeat(np.arange(len(at) - 1), np.diff(at)) + first)
            counted = pa.table({"lang": batch.column("lang").take(rows), "word": words}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from counted.rename_columns(["lang", "word", "n"]).cast(pa.schema({"lang": pa.string(), "word": pa.binary(), "n": pa.int64()})).to_batches()


def _expected(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words of languages to the expected counts of pieces, a row for each that the task has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(model.pieces)
        total = np.zeros(model.chances.shape)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                lang = pc.index_in(part.column("lang"), value_set=pa.array(model.languages)).to_numpy()
                words, times = part.column("word").cast(pa.large_binary()), part.column("n").to_numpy()
                for one in np.unique(lang):
                    mine = np.flatnonzero(lang == one)
                    total[:, one] += Lattice(words.take(pa.array(mine)), trie).counts(model.chances[:, [one]], times[mine])
        piece, lang = np.nonzero(total > 0)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], names=["piece", "lang", "n"])

    return work


def fit(
    docs: DataFrame, vocabulary: str, lang_column: str = "lang", text_column: str = "text", bounds: Fit | None = None,
    space: Workspace | None = None,
) -> Model:
    """Learn the languages that ``docs`` name, from some ``Fit.documents`` different whole texts each.

    Texts are chosen by their hash, with a share that gives so many, or fewer where there are copies, which
    count once; a language with fewer is learned from all.  Rows without a language or a text are left out.  The
    driver holds one number for each piece and language.
    """
    bounds = bounds or Fit()
    space = space or Workspace(docs.sparkSession)
    pieces = letter_pieces(vocabulary)
    rows = docs.select(F.col(lang_column).cast("string").alias("lang"), F.make_valid_utf8(F.col(text_column)).alias("text")).filter("lang IS NOT NULL AND text != ''")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(bounds.languages + 1).collect()}
    if len(sizes) > bounds.languages:
        raise ValueError(f"more than {bounds.languages} languages; Fit(languages=) allows for more")
    languages = tuple(sorted(sizes))
    shares = np.array([sizes[x] for x in languages], dtype=np.float64)
    model = Model(languages, pieces, np.full((len(pieces), len(languages)), 1 / len(pieces)), shares / max(1, shares.sum()))
    if not languages:
        return model
    spark = docs.sparkSession
    parts = 1 << 30
    # At most one row for each language.
    wanted = F.broadcast(spark.createDataFrame([(x, min(parts, -(-parts * bounds.documents // n))) for x, n in sizes.items()], "lang string, part bigint"))
    some = rows.withColumn("h", F.xxhash64("text")).join(wanted, "lang").filter(F.pmod("h", F.lit(parts)) < F.col("part"))
    sample = space.written(some.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text"))
    counted = sample.repartition(8, F.xxhash64("text")).mapInArrow(_word_counts, "lang string, word binary, n bigint")
    words = space.written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(bounds.rounds):
        counts = np.full(model.chances.shape, bounds.smoothing)
        found = words.mapInArrow(_expected(model), "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        counts[found.column("piece").to_numpy(), found.column("lang").to_numpy()] += found.column("n").to_numpy()
        model = Model(languages, pieces, counts / counts.sum(axis=0), model.shares)
    return model


def _identified(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(model.pieces)
        known, logs = pa.array([], pa.large_binary()), np.zeros((0, len(model.languages)))
        for batch in batches:
            for first, words, at, lettered in _words(batch.column("text")):
                coded = words.dictionary_encode()
                own = coded.dictionary
                place = pc.index_in(own, value_set=known)
                new = own.filter(place.is_null())
                fresh = [Lattice(new.slice(i, AT_ONCE), trie).logs(model.chances) for i in range(0, len(new), AT_ONCE)]
                each = np.empty((len(own), len(model.languages)))
                fresh_at = place.is_null().to_numpy(zero_copy_only=False)
                each[~fresh_at] = logs[place.drop_null().to_numpy()]
                if fresh:
                    each[fresh_at] = np.concatenate(fresh)
                if len(known) + len(new) <= REMEMBERED:
                    known, logs = pa.concat_arrays([known, new]), np.concatenate([logs, each[fresh_at]])
                elif len(own) <= REMEMBERED:
                    known, logs = own, each
                row, index = np.repeat(np.arange(len(at) - 1), np.diff(at)), coded.indices.to_numpy()
                sums = [np.bincount(row, weights=one[index], minlength=len(at) - 1) for one in each.T]
                total = np.stack(sums, axis=1) + np.log(model.shares)
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                names = pa.array(model.languages, pa.string()).take(pa.array(best))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(best)),
                        pc.if_else(pa.array(lettered), names, UNKNOWN),
                        pa.array(np.where(lettered, score, 0.0)),
                    ],
                    names=["doc_id", "lang_pred", "score"],
                )

    return work


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The language of every whole text, and its probability among those learned.

    Words are runs of letters and their marks, in lower case, with a space before them; all else is left
    out.  A null text, one without a letter, or any text if no language was learned, is ``und`` with score 0.
    Of languages that are equally likely the first by code point is taken.  Every row is looked at by
    itself, with whatever id; an empty table gives an empty one; other columns are not looked at.  A task
    remembers the scores of ``REMEMBERED`` words.  Returns doc_id, lang_pred and score.
    """
    plain = docs.select(F.col(id_column).alias("doc_id"), F.make_valid_utf8(F.coalesce(F.col(text_column), F.lit(""))).alias("text"))
    if not model.languages:
        return plain.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(_identified(model), f"doc_id {kind}, lang_pred string, score double")


def held_out(id_column: str = "doc_id"):
    """Whether a document is kept back: the checksum of its id, as text, is divisible by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 0

"""Best-fit packing of tokenized documents into sequences of one length.

Only the histogram of piece lengths (as many numbers as a sequence has tokens) comes to
the driver.  There a configuration linear program is solved by multiplicative weights:
each round, a knapsack dynamic program prices the best configuration under the current
weights, and lengths that lag behind gain weight.  The solution is rounded down, and
the same dynamic program fills sequences with what is left.  Spark then numbers the
pieces of each length and looks their places up.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import partitions, texts
from palimpsest.session import Workspace

#: Rounds of multiplicative weights, and how strongly a lag counts.
ROUNDS = 400
RATE = 8.0
#: Distinct segments whose ids a Python worker keeps (some 130 MB).
REMEMBERED = 600_000

#: How byte-level tokenizers cut texts before they merge.  Fixed value.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_tokenizers: dict[str, _Ids] = {}

#: White space beside space and line feed, and the mark of a cut.
_UNUSUAL = frozenset(c for c in map(chr, range(0x3001)) if c.isspace()) - {" ", "\n"} | {"\0"}
_PUNCTUATION = frozenset(".,;:!?")


def _segments(text: str) -> list[str]:
    """Cut before single spaces and around single line feeds.

    Byte-level pre-tokenization never joins what these cuts part, so the ids of a
    text are those of its segments, in order.  Texts with other white space stay whole.
    """
    plain = (
        _UNUSUAL.isdisjoint(set(text)) and "  " not in text and " \n" not in text and "\n " not in text
        and "\n\n" not in text and text[:1] not in (" ", "\n") and text[-1:] not in (" ", "\n")
    )
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if plain else [text]


class _Known(dict):
    """Ids of segments as little-endian 32-bit numbers; remembers short ones within bounds."""

    def __init__(self, encode: Callable[[str], Sequence[int]]):
        self._encode = encode

    def __missing__(self, segment: str) -> bytes:
        if len(segment) > 2 and segment[-1] in _PUNCTUATION and segment[-2].isalpha():
            # A mark after a letter is a token by itself: the word alone is more often known.
            ids = self[segment[:-1]] + self[segment[-1]]
        else:
            ids = array("I", self._encode(segment)).tobytes()
        if len(segment) < 64 and len(self) < REMEMBERED:
            self[segment] = ids
        return ids


class _Ids:
    """Ids of texts.

    The vocabulary is the tokenizer file's.  If it is a byte-level one whose merges are
    in the order of their ids, as ranks are, tiktoken applies the merges, some four
    times as fast; otherwise the tokenizers library does, on whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        merger = _merger(path)
        self._known = _Known(merger.encode_ordinary) if merger else None
        self._whole = Tokenizer.from_file(path)
        added = json.loads(open(path, encoding="utf-8").read()).get("added_tokens", [])
        self._added = tuple(token["content"] for token in added)

    def of(self, texts: list[str]) -> list[bytes]:
        if self._known is None:
            found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in found]
        look_up = self._known.__getitem__
        return [b"".join(map(look_up, _segments(t))) if t else b"" for t in texts]


    def with_added(self, texts: list[str]) -> list[bytes]:
        """Ids with the file's added tokens, such as <|endoftext|>, as one id each.

        Texts in which one stands go through the tokenizers library as it is by default.
        """
        stands = [self._known is None or any(token in t for token in self._added) for t in texts]
        library = iter(self._whole.encode_batch_fast([t for t, s in zip(texts, stands) if s], add_special_tokens=False))
        others = iter(self.of([t for t, s in zip(texts, stands) if not s]) if not all(stands) else [])
        return [array("I", next(library).ids).tobytes() if s else next(others) for s in stands]


def _merger(path: str):
    """A tiktoken encoding of the same vocabulary, or None if the file's rules are others."""
    import tiktoken

    rules = json.loads(open(path, encoding="utf-8").read())
    model, before = rules["model"], rules.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        and before.get("use_regex", True) and not rules.get("normalizer") and not model.get("dropout")
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    )
    if not plain:
        return None
    # Byte-level vocabularies write printable bytes as they are and the others from 256 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary = model["vocab"]
    merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or merged != sorted(merged):
        return None
    special = {t["content"] for t in rules.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, end: int, capacity: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids of every piece; no shuffle.

    The end id closes every document.  A document longer than ``capacity`` is cut;
    its first piece has what does not fill a whole one.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = _Ids(tokenizer)
        ids = _tokenizers[tokenizer]
        closing = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, piece, start, length, crc, own = [], [], [], [], [], []
                for row, data in enumerate(ids.with_added(part.column("text").to_pylist())):
                    data += closing
                    n = len(data) // 4
                    lo, k = 0, 0
                    while lo < n:
                        size = capacity if lo or n <= capacity else n % capacity or capacity
                        size = min(size, n - lo)
                        body = data[4 * lo : 4 * (lo + size)]
                        rows.append(row), piece.append(k), start.append(lo), length.append(size)
                        crc.append(zlib.crc32(body)), own.append(body)
                        lo, k = lo + size, k + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(rows, pa.int64())),
                        pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()), pa.array(own, pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    plain = texts(docs, id_column, text_column)
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    )


def _price(weight: np.ndarray, capacity: int) -> list[int]:
    """Knapsack: the lengths (with repetition) of greatest total weight that fit; weight 0 means absent."""
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    usable = np.where(weight > 0, weight, -np.inf)
    for c in range(1, capacity + 1):
        values = best[c - 1 :: -1][:c] + usable[1 : c + 1]
        i = int(values.argmax())
        if values[i] > best[c - 1] + 1e-12:
            best[c], choice[c] = values[i], i + 1
        else:
            best[c] = best[c - 1]
    out, c = [], capacity
    while c > 0:
        if choice[c]:
            out.append(int(choice[c]))
            c -= int(choice[c])
        else:
            c -= 1
    return out


def configurations(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations and how often each is used, so that every piece has exactly one place.

    A configuration is ((length, copies), ...), longest first.
    """
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        demand[length] = n
    uses: dict[tuple[tuple[int, int], ...], int] = {}

    def use(lengths: list[int], times: int) -> None:
        sizes, copies = np.unique(lengths, return_counts=True)
        key = tuple((int(s), int(c)) for s, c in zip(sizes[::-1], copies[::-1]))
        uses[key] = uses.get(key, 0) + times
        for size, c in key:
            demand[size] -= c * times

    if demand[capacity]:
        use([capacity], int(demand[capacity]))
    if not demand.any():
        return list(uses.items())

    # Multiplicative weights on the fractional program.
    wanted = demand.astype(float)
    active = wanted > 0
    lengths = np.arange(capacity + 1) / capacity
    covered = np.zeros(capacity + 1)
    amounts: dict[tuple[int, ...], float] = {}
    for _ in range(min(ROUNDS, 20 * int(active.sum()))):
        share = np.where(active, covered / np.maximum(wanted, 1), 0)
        weight = np.where(active, lengths * np.exp(RATE * (share[active].mean() - share)), 0)
        chosen = _price(weight, capacity)
        sizes, copies = np.unique(chosen, return_counts=True)
        step = float((wanted[sizes] / copies).min()) / 4
        covered[sizes] += copies * step
        amounts[tuple(chosen)] = amounts.get(tuple(chosen), 0) + step
    # No length may be covered beyond its demand; then round down.
    excess = np.maximum(1.0, np.where(active, covered / np.maximum(wanted, 1), 1))
    for chosen, amount in sorted(amounts.items(), key=lambda x: -x[1]):
        sizes, copies = np.unique(chosen, return_counts=True)
        times = int(min(amount / excess[sizes].max(), (demand[sizes] // copies).min()))
        if times > 0:
            use(list(chosen), times)

    # What is left: the longest length, and the fullest filling beside it.
    while demand.any():
        longest = int(np.flatnonzero(demand)[-1])
        left = demand.copy()
        left[longest] -= 1
        chosen, room = [longest], capacity - longest
        while room > 0 and left[1 : room + 1].any():
            weight = np.where(left[: room + 1] > 0, np.arange(room + 1, dtype=float), 0)
            fresh = False
            for size in _price(weight, room):
                if left[size] > 0:
                    left[size] -= 1
                    chosen.append(size)
                    room -= size
                    fresh = True
            if not fresh:
                break
        sizes, copies = np.unique(chosen, return_counts=True)
        use(chosen, max(1, int((demand[sizes] // copies).min())))
    return list(uses.items())


def pack(
    docs: DataFrame,
    tokenizer: str,
    end: int = 2,
    capacity: int = 1024,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Every piece with the sequence that has it and its place there.

    Texts are tokenized once; the written pieces are small.  Pieces of a length are
    numbered in parts (by a hash of id and piece) with offsets from the parts'
    counts, so a length that a third of all pieces share is no single task's work.
    Places are found in a broadcast table with a few rows for each configuration:
    its size depends on ``capacity``, not on the input.

    A null or empty text is the end id alone; a null id is a document like any
    other; repeated rows are packed each; an empty table gives an empty one.  Other
    columns are not looked at.  Returns doc_id, piece, start, length, ids_crc32,
    sequence_id and offset.
    """
    space = Workspace(docs.sparkSession)
    parts = max(16, partitions(docs))
    pieces = space.written(
        tokenized_pieces(docs, tokenizer, end, capacity, id_column, text_column)
        .drop("ids")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    )
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    slots, first, begun = [], 0, dict.fromkeys(histogram, 0)
    for configuration, times in configurations(histogram, capacity):
        at = 0
        for length, copies in configuration:
            lo = begun[length]
            begun[length] = lo + copies * times
            slots.append((length, lo, begun[length], copies, first, at))
            at += length * copies
        first += times
    places = docs.sparkSession.createDataFrame(
        slots, "length bigint, lo bigint, hi bigint, copies bigint, first bigint, at bigint"
    )
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    offsets = counts.select("length", "part", before.alias("before"))
    numbered = (
        pieces.withColumn(
            "nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32"))
        )
        .join(offsets, ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("nth") - 1)
    )
    nth = F.col("rank") - F.col("lo")
    return (
        numbered.join(F.broadcast(places), "length")
        .filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
            (F.col("at") + nth % F.col("copies") * F.col("length")).cast("long").alias("offset"),
        )
    )

"""Ranked lexical search by dense blocked matrix multiplication.

Items are taken in blocks.  A block's vocabulary is cut into tiles; a tile's weights
are a dense matrix of items by terms, a run of documents gives a dense matrix of terms
by documents with the impact of each term, and their product in float64 has the scores.
All entries are whole numbers and every partial sum of a tile stays below 2^53, so the
product is exact; tiles are added up as 64-bit integers.  Tasks keep the best documents
of each item, with ties decided by the id, and only these are exchanged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palimpsest.llm.arrays import NO_TERM, as_strings, lower_ascii, text_parts, words_of
from palimpsest.llm.common import texts
from palimpsest.session import Workspace

#: Documents returned for an item.
BEST = 20
#: Items of a block on average, and the characters of their texts: what one pass is about.
ITEMS, ITEM_CHARS = 512, 1 << 23
#: Terms and documents of a tile.
TERMS, DOCUMENTS = 2048, 1024
#: Float64 adds whole numbers exactly below this.
EXACT = 1 << 53
#: No impact reaches this: floor(10^9 tf / (10^3 tf + 12 m)) with m over 0.
IMPACT = 10**6
#: The rows an item's candidates are dealt out to before the last ranking.
SPREAD = 32


@dataclass(frozen=True)
class Block:
    """The items of one pass: their ids, their terms, and how often an item has a term."""

    ids: pa.Array
    terms: pa.Array
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray


def _block(rows: list[tuple[object, bytes]], kind: pa.DataType) -> Block:
    """Of bounded size, see ``ITEMS``: made on the driver and sent to the tasks."""
    found = []
    for _, text in rows:
        data = lower_ascii(np.frombuffer(text, dtype=np.uint8))
        starts, ends, _ = words_of(data, np.array([0, len(data)]), NO_TERM)
        found.append(Counter(as_strings(data, starts, ends).to_pylist()))
    terms = sorted(set().union(*found))
    place = {t: i for i, t in enumerate(terms)}
    entries = sorted((place[t], i, n) for i, own in enumerate(found) for t, n in own.items())
    term, item, times = np.array(entries, dtype=np.int64).reshape(-1, 3).T
    return Block(pa.array([r[0] for r in rows], kind), pa.array(terms, pa.large_binary()), item, term, times)


def _counts(terms: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number of terms of each text, and those of ``terms`` it has with their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, len(terms))
        for batch in batches:
            for first, end, data, offsets in text_parts(batch.column("text")):
                data = lower_ascii(data)
                starts, ends, at = words_of(data, offsets, NO_TERM)
                found = pc.index_in(as_strings(data, starts, ends), value_set=terms)
                row = np.repeat(np.arange(end - first), np.diff(at))
                known = found.is_valid().to_numpy(zero_copy_only=False)
                key = row[known] * width + found.drop_null().to_numpy()
                key, times = np.unique(key, return_counts=True)
                bounds = pa.array(np.searchsorted(key, np.arange(end - first + 1) * width).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, end - first),
                        pa.array(np.diff(at).astype(np.int64)),
                        pa.ListArray.from_arrays(bounds, pa.array((key % width).astype(np.int32))),
                        pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "n", "terms", "times"],
                )

    return work


def tiles(
    item: np.ndarray, term: np.ndarray, weight: np.ndarray, items: int, terms: int, width: int = TERMS
) -> Iterator[tuple[int, int, np.ndarray]]:
    """First term, end term and the dense weights of tiles whose sums times ``IMPACT`` stay below ``EXACT``.

    A tile with a larger sum is halved; a single term with a larger weight is cut into
    several tiles of that term, whose weights add up to it.
    """
    most = (EXACT - 1) // IMPACT
    waiting = [(lo, min(lo + width, terms)) for lo in range(0, terms, width)][::-1]
    while waiting:
        lo, hi = waiting.pop()
        a, b = np.searchsorted(term, [lo, hi])
        dense = np.zeros((items, hi - lo), dtype=np.int64)
        dense[item[a:b], term[a:b] - lo] = weight[a:b]
        if int(dense.sum(axis=1).max(initial=0)) <= most:
            yield lo, hi, dense.astype(np.float64)
        elif hi - lo > 1:
            mid = (lo + hi) // 2
            waiting += [(mid, hi), (lo, mid)]
        else:
            while dense.any():
                part = np.minimum(dense, most)
                dense = dense - part
                yield lo, hi, part.astype(np.float64)


def _best(table: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows of every item: highest score, then smallest id, null first."""
    order = pc.sort_indices(
        table, sort_keys=[("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_start"
    )
    table = table.take(order)
    item = table.column("item").to_numpy()
    return table.filter(pa.array(np.arange(len(item)) - np.searchsorted(item, item) < k))


def _scores(
    block: Block, weights: np.ndarray, documents: int, length: int, k: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``k`` best documents of the task for each item of the block."""
    items, terms, width, tall = len(block.ids), len(block.terms), TERMS, DOCUMENTS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = None
        best, least = None, np.ones(items, dtype=np.int64)
        for whole in batches:
            for first in range(0, whole.num_rows, tall):
                batch = whole.slice(first, tall)
                rows = batch.num_rows
                lengths = pc.list_value_length(batch.column("terms")).to_numpy()
                term = batch.column("terms").flatten().to_numpy()
                times = batch.column("times").flatten().to_numpy().astype(np.int64)
                if not len(term):
                    continue
                n = batch.column("n").to_numpy().tolist()
                m = np.array([75 + 25 * x * documents // length for x in n], dtype=np.int64)
                row = np.repeat(np.arange(rows), lengths)
                impact = (1_000_000_000 * times) // (1000 * times + 12 * m[row])
                order = np.argsort(term, kind="stable")
                row, term, impact = row[order], term[order], impact[order].astype(np.float64)
                scores = np.zeros((items, rows), dtype=np.int64)
                if dense is None and terms <= 4 * width:
                    dense = list(tiles(block.item, block.term, weights, items, terms, width))
                for lo, hi, tile in dense or tiles(block.item, block.term, weights, items, terms, width):
                    a, b = np.searchsorted(term, [lo, hi])
                    if a < b:
                        impacts = np.zeros((hi - lo, rows))
                        impacts[term[a:b] - lo, row[a:b]] = impact[a:b]
                        scores += (tile @ impacts).astype(np.int64)
                bar = least
                if rows > k:
                    bar = np.maximum(least, np.partition(scores, rows - k, axis=1)[:, rows - k])
                item, at = np.nonzero(scores >= bar[:, None])
                if not len(item):
                    continue
                found = pa.table(
                    {"item": item, "doc_id": batch.column("doc_id").take(pa.array(at)), "score": scores[item, at]}
                )
                best = _best(found if best is None else pa.concat_tables([best, found]), k)
                held, score = best.column("item").to_numpy(), best.column("score").to_numpy()
                full = np.bincount(held, minlength=items) >= k
                last = np.searchsorted(held, np.arange(items), side="right") - 1
                least = np.where(full, score[last], 1)
        if best is not None:
            best = best.append_column("item_id", block.ids.take(best.column("item").combine_chunks()))
            yield from best.select(["item", "item_id", "doc_id", "score"]).combine_chunks().to_batches()

    return work


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    k: int = BEST,
    space: Workspace | None = None,
) -> DataFrame:
    """The ``k`` best documents for each item, best first; documents without a term of the item are left out.

    Terms are runs of ASCII letters, digits and all other characters above ASCII; only A-Z
    are lower-cased.  N documents have a term, L is the number of all their terms; a term in
    df documents weighs floor(1000 ln((2N + 2) / (2df + 1))), and a document with n terms, m =
    75 + 25nN / L, adds that weight times 10^9 tf / (10^3 tf + 12m) for each of the item's
    terms, repeats included, with quotients rounded down.

    Documents are read once for each block of items (about ``ITEMS`` of them) and reduced
    to their counts of the block's terms, a table in ``space``.  A block goes to the
    tasks from the driver, and its size is bounded by ``ITEMS``, ``ITEM_CHARS`` and the longest item.
    A task holds ``DOCUMENTS`` rows of scores and ``k`` rows for each item.

    Null and empty texts have no terms; a null id counts as the smallest; rows of ``docs``
    with one id are ranked as rows of their own, in either order where they score the same;
    rows of ``items`` equal in id and text are one item, of items with the same id and other
    texts each has its ranks.  An empty table on either side gives an empty one.  Other columns
    are not looked at.  Returns item_id, rank (from 1), doc_id and score.
    """
    space = space or Workspace(docs.sparkSession)
    plain = texts(docs, id_column, text_column)
    wanted = items.select(F.col(item_column).alias("item_id"), F.col(item_text_column).alias("text")).filter("text IS NOT NULL").distinct()
    kind, item_kind = plain.schema["doc_id"].dataType, wanted.schema["item_id"].dataType
    wanted = space.written(wanted)
    many, chars = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(many / ITEMS), math.ceil(chars / ITEM_CHARS))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found, size = None, None
    for b in range(blocks):
        rows = [(r["item_id"], r["text"].encode()) for r in wanted.filter(number == b).collect()]
        block = _block(rows, to_arrow_type(item_kind))
        if found is not None and not len(block.terms):
            continue
        counted = space.written(
            plain.mapInArrow(_counts(block.terms), f"doc_id {kind.simpleString()}, n bigint, terms array<int>, times array<int>")
        )
        size = size or counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        documents, length = size
        df = np.zeros(len(block.terms), dtype=np.int64)
        # At most one row for each term of the block.
        for t, n in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[t] = n
        weigh = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64)
        scored = counted.filter(F.size("terms") > 0).mapInArrow(
            _scores(block, block.times * weigh[block.term], documents, length, k),
            f"item bigint, item_id {item_kind.simpleString()}, doc_id {kind.simpleString()}, score bigint",
        )
        scored = scored.withColumn("item", F.col("item") * blocks + b)
        found = scored if found is None else found.unionByName(scored)
    best = [F.desc("score"), F.asc_nulls_first("doc_id")]
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))
    some = dealt.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*best))).filter(F.col("r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")

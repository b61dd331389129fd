"""Near-duplicates by chosen-path set similarity join.

In every one of several independent trees a document goes down a path chosen by the
minwise tokens of its set: similar sets choose the same token with the probability of
their similarity.  A node with few documents is compared exhaustively; a node with
more is branched by further tokens.  Sketches pick the documents of a node worth
comparing, and full sets decide.

A node that is large to the last holds documents that are nearly alike, as a rule one mass of
them.  It is dealt into blocks that share some pivots, each of which is compared exhaustively, so the
mass becomes one component in time that grows with its size; then only what is not of the
node's largest component is compared with all of the node.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrays import bounds, groups, lower_ascii, mix, text_parts, word_hashes, words_of
from palimpsest.llm.common import marks, may_be_marked, texts
from palimpsest.llm.components import components
from palimpsest.session import Workspace

#: Words in a shingle; a shorter text is one shingle.
SHINGLE = 3
#: Similarity of linked sets, per cent.
PERCENT = 85
#: The tokens chosen on a path after which nodes are looked at.
LEVELS = (1, 3, 6)
#: So often, at most, a pair of the similarity asked for is missed in all trees if its nodes
#: are small only after the last level.  At 85 % that takes 12 trees, at 80 % it takes 19.
MISSED = 0.0035
#: Documents in a node that is compared; larger ones at the last level are dealt into blocks of so many.
NODE = 1000
#: Documents of a large node that all of its blocks have.
PIVOTS = 16


@dataclass(frozen=True)
class Likeness:
    """Words in a shingle, the similarity of linked sets in per cent, and what follows from it."""

    shingle: int = SHINGLE
    percent: int = PERCENT

    def __post_init__(self) -> None:
        if self.shingle < 1 or not 0 < self.percent <= 100:
            raise ValueError("a shingle has a word or more, a similarity is over 0 and at most 100 per cent")

    @cached_property
    def trees(self) -> int:
        met = (self.percent / 100) ** LEVELS[-1]
        return 1 if met == 1 else math.ceil(math.log(MISSED) / math.log1p(-met))

    @cached_property
    def draws(self) -> int:
        return self.trees * LEVELS[-1]

    @cached_property
    def agree(self) -> int:
        """Bytes of sketches that must agree: five deviations below what the similarity lets expect."""
        same = self.percent / 100 + (1 - self.percent / 100) / 256
        return max(0, math.floor(self.draws * same - 5 * math.sqrt(self.draws * same * (1 - same))))

    @cached_property
    def seeds(self) -> np.ndarray:
        return mix(np.arange(1, self.draws + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For parts of a column: its first row, the sorted distinct shingles of all rows, and the rows' offsets."""
    for first, end, data, offsets in text_parts(column):
        data = lower_ascii(data)
        starts, ends, at = words_of(data, offsets)
        h = word_hashes(data, starts, ends)
        # Sums of hashes times powers, over a shingle's words, or what a shorter text has.
        padded = np.concatenate([h, np.zeros(shingle, dtype=np.uint64)])
        s = padded[: len(h)].copy()
        for k in range(1, shingle):
            s = mix(s) + padded[k : len(h) + k]
        s = mix(s)
        found, sizes = [], [0]
        for row in range(end - first):
            lo, hi = int(at[row]), int(at[row + 1])
            if hi - lo >= shingle:
                own = np.unique(s[lo : hi - shingle + 1])
            elif hi > lo:
                x = np.uint64(hi - lo)
                whole = np.array([x], dtype=np.uint64)
                for value in h[lo:hi]:
                    whole = mix(whole * np.uint64(31) + value)
                own = whole
            else:
                own = s[:0]
            found.append(own)
            sizes.append(len(own))
        yield first, np.concatenate(found), np.cumsum(sizes)


def _signatures(like: Likeness) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Set size, 128 bits of the whole set, node keys by tree and level, and the sketch."""
    seeds = like.seeds
    odd = mix(seeds) | np.uint64(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, s, offsets in _sets(batch.column("text"), like.shingle):
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                cut = offsets[:-1][full]
                xor, total = np.zeros((2, len(sizes)), dtype=np.uint64)
                keys = np.zeros((len(sizes), like.trees * len(LEVELS)), dtype=np.uint64)
                sketch = np.zeros((len(sizes), like.draws), dtype=np.uint8)
                if len(full):
                    xor[full] = np.bitwise_xor.reduceat(s, cut)
                    total[full] = np.add.reduceat(mix(s), cut)
                    for tree in range(like.trees):
                        path = np.full(len(full), mix(np.array([tree + 1], dtype=np.uint64))[0])
                        for depth in range(LEVELS[-1]):
                            draw = tree * LEVELS[-1] + depth
                            v = (s ^ seeds[draw]) * odd[draw]
                            v ^= v >> np.uint64(29)
                            least = np.minimum.reduceat(v, cut)
                            path = mix(path + least)
                            sketch[full, draw] = mix(least).astype(np.uint8)
                            if depth + 1 in LEVELS:
                                keys[full, tree * len(LEVELS) + LEVELS.index(depth + 1)] = path
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, n),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(xor.view(np.int64)),
                        pa.array(total.view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.view(np.int64).ravel())
                        ),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                    ],
                    names=["doc_id", "n", "x", "s", "keys", "sketch"],
                )

    return work


def _worth_comparing(like: Likeness) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of every cell the documents with a partner in another part whose sketch agrees, unless an earlier tree has the pair."""

    def all_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            edges = bounds(table, ["cell"])
            n, parts = table.column("n").to_numpy(), table.column("part").to_numpy()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, like.draws)
            leaves = table.column("leaves").combine_chunks().flatten().to_numpy().reshape(-1, like.trees)
            trees = table.column("tree").to_numpy()
            keep = np.zeros(table.num_rows, dtype=bool)
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo < 2:
                    continue
                own, sizes, leaf, part, tree = sketches[lo:hi], n[lo:hi], leaves[lo:hi], parts[lo:hi], int(trees[lo])
                for i in range(hi - lo - 1):
                    rest = slice(i + 1, hi - lo)
                    may = part[rest] != part[i]
                    may &= 100 * np.minimum(sizes[rest], sizes[i]) >= like.percent * np.maximum(sizes[rest], sizes[i])
                    other = i + 1 + np.flatnonzero(may)
                    other = other[(own[other] == own[i]).sum(axis=1) >= like.agree]
                    if tree and len(other):
                        met = (leaf[other, :tree] == leaf[i, :tree]) & (leaf[i, :tree] != 0)
                        other = other[~met.any(axis=1)]
                    if len(other):
                        keep[lo + i] = True
                        keep[lo + other] = True
            chosen = table.select(["cell", "doc_id", "part"]).filter(pa.array(keep))
            yield from chosen.combine_chunks().to_batches()

        return groups(batches, ["cell"], work)

    return all_groups


def _as_rows(like: Likeness) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row with the set for each cell of a document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cells")
            for first, s, offsets in _sets(batch.column("text"), like.shingle):
                row, cell = [], []
                for i in range(len(offsets) - 1):
                    for c in cells[first + i].as_py():
                        row.append(i)
                        cell.append(c)
                data = [s[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(offsets) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell, pa.int64()),
                        batch.column("doc_id").take(pa.array([first + i for i in row], pa.int64())),
                        batch.column("part").take(pa.array([first + i for i in row], pa.int64())),
                        pa.array([data[i] for i in row], pa.large_binary()),
                    ],
                    names=["cell", "doc_id", "part", "tokens"],
                )

    return work


def _links(like: Likeness) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of each cell that join different parts of it, confirmed on full sets.

    A pair whose documents are joined already needs no link: components stay the same.
    """

    def all_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            edges = bounds(table, ["cell"])
            tokens, ids, parts = table.column("tokens"), table.column("doc_id").combine_chunks(), table.column("part").to_numpy()
            a: list[int] = []
            b: list[int] = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                k = int(hi - lo)
                if k < 2:
                    continue
                own = [np.frombuffer(tokens[int(i)].as_py(), dtype=np.uint64) for i in range(lo, hi)]
                sizes = np.array([len(x) for x in own])
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                every, local = np.unique(np.concatenate(own), return_inverse=True)
                part = np.unique(parts[lo:hi], return_inverse=True)[1]
                mark = np.zeros(len(every), dtype=np.int64)
                for i in range(k - 1):
                    other = part[i + 1 :] != part[i]
                    other &= 100 * np.minimum(sizes[i + 1 :], sizes[i]) >= like.percent * np.maximum(sizes[i + 1 :], sizes[i])
                    if not other.any():
                        continue
                    mine = local[offsets[i] : offsets[i + 1]]
                    mark[mine] = 1
                    common = np.add.reduceat(mark[local[offsets[i + 1] :]], offsets[i + 1 : -1] - offsets[i + 1])
                    mark[mine] = 0
                    linked = other & (100 * common >= like.percent * (sizes[i] + sizes[i + 1 :] - common))
                    for j in i + 1 + np.flatnonzero(linked):
                        if part[j] != part[i]:
                            part[part == part[j]] = part[i]
                            a.append(int(lo) + i)
                            b.append(int(lo) + int(j))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x, pa.int64())) for x in (a, b)], names=["a", "b"])

        return groups(batches, ["cell"], work)

    return all_groups


def _leaves(reps: DataFrame, space: Workspace) -> DataFrame:
    """(doc_id, tree, key, size): for each tree the first node of a document's path that is
    small enough, or the last; nodes with one document are left out."""
    width = len(LEVELS)
    rows = reps.select("doc_id", F.posexplode("keys").alias("at", "key"))
    found = None
    for level in range(width):
        here = rows.filter(F.col("at") % width == level).select("doc_id", F.floor(F.col("at") / width).cast("int").alias("tree"), "key")
        if level:
            here = here.join(open_, ["doc_id", "tree"], "left_semi")
        # Written, so that a hot node can be split in the join.
        size = space.written(here.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
        sized = space.written(here.join(size, "key"))
        small = sized if level == width - 1 else sized.filter(F.col("size") <= NODE)
        found = small if found is None else found.union(small)
        open_ = sized.filter(F.col("size") > NODE).select("doc_id", "tree")
    return found.select("doc_id", "tree", "key", "size")


def _block(h: Column, size: Column) -> Column:
    return F.pmod(h, F.ceil(size / NODE)).cast("int")


def _blocks(large: DataFrame, space: Workspace) -> DataFrame:
    """(doc_id, tree, cell): blocks of large nodes, with the node's pivots in each.

    A document is in a block of the first tree in which its node is large; the others are looked at
    where components are left apart.
    """
    first = large.groupBy("doc_id").agg(F.min(F.struct("tree", "key", "size", "h")).alias("f")).select("doc_id", "f.*")
    first = space.written(first)
    # The least hash of each of so many parts: one row a node and part, whatever its size.
    part = F.pmod(F.xxhash64("h"), F.lit(PIVOTS)).alias("p")
    pivots = (
        first.groupBy("tree", "key", "size", part)
        .agg(F.min_by("doc_id", "h").alias("doc_id"))
        .select("doc_id", "tree", "key", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / NODE).cast("int") - 1)).alias("block"))
    )
    dealt = first.select("doc_id", "tree", "key", _block(F.col("h"), F.col("size")).alias("block"))
    return dealt.unionByName(pivots).distinct().select("doc_id", "tree", F.xxhash64("tree", "key", "block").alias("cell"))


def _rest(large: DataFrame, first: DataFrame, space: Workspace) -> DataFrame:
    """(doc_id, tree, cell, part): what is not of a large node's largest component, beside every block of the node."""
    node = ["tree", "key"]
    known = first.select(F.col("id").alias("doc_id"), "component")
    placed = space.written(
        large.join(known, "doc_id", "left").withColumn("part", F.xxhash64(F.coalesce("component", "doc_id"))).drop("component")
    )
    counts = placed.groupBy(*node, "part").agg(F.count("*").alias("c"))
    mass = space.written(
        counts.groupBy(*node).agg(F.max_by("part", F.struct("c", "part")).alias("mass"), (F.sum("c") - F.max("c")).alias("others")).filter("others > 0")
    )
    dealt = placed.join(mass, node)
    others = F.ceil(F.col("others") / NODE).cast("int")
    blocks = F.ceil(F.col("size") / NODE).cast("int")
    block = _block(F.col("h"), F.col("size"))
    cell = F.xxhash64(*node, "i", "j").alias("cell")
    every = dealt.select("doc_id", *node, "part", F.explode(F.sequence(F.lit(0), others - 1)).alias("i"), block.alias("j"))
    own = F.pmod(F.xxhash64("h"), others).cast("int")
    beside = dealt.filter("part <> mass").select("doc_id", *node, "part", own.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
    return every.unionByName(beside).distinct().select("doc_id", "tree", cell, "part")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Size of the shingle set and component of every document.

    Linked are documents whose sets of ``shingle`` words are at least ``percent`` per cent alike.

    Equal sets are one class from the start, found by grouping 128 bits of the set, so
    thousands of copies cost no comparison.  The signature table has a few hundred
    bytes a document; sets travel only for documents with a likely partner, as a rule
    once.  A cell is hardly larger than two blocks of ``NODE`` documents, and emits
    fewer links than it has documents.

    A null text or one without words has an empty set and is linked with nothing; a
    null id is linked with nothing, its component is null and it is kept; rows with
    one id are one document with either text's links; an empty table gives an empty
    one.  Other columns are not looked at.  Returns doc_id, n_shingles, component_id
    and kept.
    """
    like = Likeness(shingle, percent)
    space = Workspace(docs.sparkSession)
    plain = texts(docs, id_column, text_column)
    kind = plain.schema["doc_id"].dataType.simpleString()
    signed = space.written(
        plain.mapInArrow(_signatures(like), f"doc_id {kind}, n bigint, x bigint, s bigint, keys array<bigint>, sketch binary")
    )
    whole = ["n", "x", "s"]
    usable = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # Written, so that the join's two sides are dealt out for it alone and a hot class can be split.
    classes = space.written(usable.groupBy(*whole).agg(F.min("doc_id").alias("rep")))
    member = space.written(usable.select("doc_id", *whole).join(classes, whole).select("doc_id", "n", "rep"))
    reps = usable.join(classes.select(*whole, F.col("rep").alias("doc_id")), ["doc_id", *whole], "left_semi").dropDuplicates(["doc_id", *whole])
    reps = space.written(reps.select("doc_id", "n", "keys", "sketch"))

    leaves = space.written(_leaves(reps, space)).withColumn("tree", F.col("tree").cast("int"))
    small = F.col("size") <= NODE
    # A tree has compared a pair if its node was small.
    by_tree = F.map_from_entries(F.collect_set(F.struct("tree", "key")))
    met = leaves.filter(small).dropDuplicates(["doc_id", "tree"]).groupBy("doc_id").agg(by_tree.alias("m")).select(
        "doc_id", F.transform(F.sequence(F.lit(0), F.lit(like.trees - 1)), lambda t: F.coalesce(F.element_at("m", t), F.lit(0).cast("long"))).alias("met")
    )
    unmet = F.array_repeat(F.lit(0).cast("long"), like.trees)
    payload = space.written(reps.join(met, "doc_id", "left").select("doc_id", "n", "sketch", F.coalesce("met", unmet).alias("leaves")))

    def linked(cells: DataFrame) -> DataFrame:
        """Links between documents of a cell (doc_id, tree, cell, part) whose parts differ."""
        compared = (
            cells.join(payload, "doc_id")
            .repartition("cell")
            .sortWithinPartitions("cell", "doc_id")
            .select("cell", "tree", "doc_id", "part", "n", "sketch", "leaves")
            .mapInArrow(_worth_comparing(like), f"cell bigint, doc_id {kind}, part bigint")
        )
        worth = space.written(compared.groupBy("doc_id").agg(F.collect_set("cell").alias("cells"), F.first("part").alias("part")))
        # Only texts that are compared are exchanged.
        asked = may_be_marked(plain, ["doc_id"], marks(worth, ["doc_id"], space)).filter("marked").drop("marked")
        return (
            asked.join(worth, "doc_id")
            .mapInArrow(_as_rows(like), f"cell bigint, doc_id {kind}, part bigint, tokens binary")
            .repartition("cell")
            .sortWithinPartitions("cell", "doc_id")
            .mapInArrow(_links(like), f"a {kind}, b {kind}")
        )

    large = space.written(leaves.filter(~small).withColumn("h", F.xxhash64("doc_id", "tree", "key")))
    alone = F.xxhash64("doc_id").alias("part")
    cells = leaves.filter(small).select("doc_id", "tree", F.xxhash64("tree", "key").alias("cell"), alone)
    some_large = not large.isEmpty()
    if some_large:
        cells = cells.unionByName(_blocks(large, space).select("doc_id", "tree", "cell", alone))
    found = components(linked(cells), space)
    if some_large:
        first = space.written(found)
        rest = _rest(large, first, space)
        if not rest.isEmpty():
            found = components(linked(rest).unionByName(first.select(F.col("id").alias("a"), F.col("component").alias("b"))), space)
    joined = found
    known = member.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", "n", F.coalesce("component", "rep").alias("component_id")
    )
    unlinked = signed.filter((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return known.unionByName(unlinked).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )

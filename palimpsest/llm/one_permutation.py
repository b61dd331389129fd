"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the top bits choose a bin and the smallest hash of a bin
represents it.  Empty bins borrow from bins that a fixed random probe order finds, the
same for all documents (optimal densification).  Of each bin the low-order bits are
packed; the likeness of two fingerprints is corrected for bits that agree by chance.
DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.expr import let
from palimpsest.llm.common import partitions, texts, words
from palimpsest.session import Workspace

#: Words in a shingle; a shorter text with a word is one shingle.
SHINGLE = 5
#: Bins: one for each value of the hash's top BIN_BITS bits.
BIN_BITS = 8
BINS = 2**BIN_BITS
#: Bits kept of a bin; LANES bins share a 64-bit number.
LOW_BITS = 4
LANES = 64 // LOW_BITS
#: Probes for a full bin before all full bins are ranked.
PROBES = 20
_NULL_ID = -(1 << 63)
_SHIFT = 64 - BIN_BITS
_ONE_A_LANE = int("1" * LANES, 16)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _bin(h: Column) -> Column:
    return (F.shiftright(h, _SHIFT) + BINS // 2).cast("int")


def _shingles(text: Column) -> Column:
    def of(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - SHINGLE, F.lit(0)))
        # Past the end there is null, which a hash passes over.
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(SHINGLE))))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) > 0, of(h)))


def _probe_order(t: int) -> Column:
    """For each bin the bin that its t-th probe looks into."""
    digest = lambda j: hashlib.blake2b(f"{t}:{j}".encode(), digest_size=8).digest()
    return F.lit([int.from_bytes(digest(j), "big") % BINS for j in range(BINS)])


def _densified(minima: Column) -> Column:
    """One hash a bin; ``minima`` has those of full bins, in bin order, one at least."""
    gap = lambda m, i: _bin(m) - F.coalesce(_bin(F.get(minima, i - 1)), F.lit(-1)) - 1
    none = F.lit(None).cast("long")
    spaced = F.concat(
        F.flatten(F.transform(minima, lambda m, i: F.array_append(F.array_repeat(none, gap(m, i)), m))),
        F.array_repeat(none, BINS - 1 - _bin(F.element_at(minima, -1))),
    )

    def filled(bins: Column) -> Column:
        def borrow(j: Column) -> Column:
            probes = (F.get(bins, F.get(_probe_order(t), j)) for t in range(PROBES))
            ranked = F.array_min(F.transform(minima, lambda m: F.struct(F.xxhash64(j, _bin(m)).alias("r"), m.alias("m"))))
            return F.coalesce(*probes, ranked["m"])

        return F.transform(bins, lambda h, j: F.coalesce(h, borrow(j)))

    return let(spaced, filled)


def fingerprint(text: Column) -> Column:
    """The packed bins as ``BINS / LANES`` numbers; null for a text without words."""

    def minima(ordered: Column) -> Column:
        return F.filter(ordered, lambda h, i: (i == 0) | (F.shiftright(h.bitwiseXOR(F.get(ordered, i - 1)), _SHIFT) != 0))

    def packed(bins: Column) -> Column:
        lane = lambda acc, h: F.shiftleft(acc, LOW_BITS).bitwiseOR(h.bitwiseAND(2**LOW_BITS - 1))
        return F.transform(
            F.sequence(F.lit(0), F.lit(BINS // LANES - 1)),
            lambda c: F.aggregate(F.slice(bins, c * LANES + 1, LANES), _long(0), lane),
        )

    return let(
        F.sort_array(_shingles(text)),
        lambda s: F.when(s.isNotNull(), let(minima(s), lambda m: let(_densified(m), packed))),
    )


def as_text(packed: Column) -> Column:
    """Hexadecimal digits; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1; texts without words are like each other only."""
    spread = lambda x: reduce(Column.bitwiseOR, (F.shiftrightunsigned(x, k) for k in range(LOW_BITS)))
    differ = lambda x, y: let(
        x.bitwiseXOR(y), lambda z: F.bit_count(spread(z).bitwiseAND(_long(_ONE_A_LANE)))
    )
    equal = 1 - F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda acc, n: acc + n) / BINS
    by_chance = 2.0**-LOW_BITS
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(
        F.greatest((equal - by_chance) / (1 - by_chance), F.lit(0.0))
    )


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_chars and the packed fingerprint of each row, without a shuffle.

    Null texts are empty, empty ones have a null fingerprint; equal texts have equal
    fingerprints; an empty table gives an empty one; other columns are not looked at.
    """
    return texts(docs, id_column, text_column).select(
        "doc_id",
        F.xxhash64("text").alias("th"),
        F.length("text").cast("long").alias("n_chars"),
        fingerprint(F.col("text")).alias("packed"),
    )


def compare_neighbours(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text and the next document's.

    The edited text has the last half of its code points replaced by the first as
    many, or all, of the next document by ascending id; after the last comes the
    first.  Successors are found among ids alone, sorted in ranges; then each next
    text travels once, cut to what is needed.

    Ids are whole numbers.  A null id comes first; rows equal in id and text are one document, others with
    one id are ordered by a hash of their text; a single document is its own
    successor.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    space = Workspace(docs.sparkSession)
    own = space.written(fingerprints(docs, id_column, text_column))
    ranged = space.written(
        own.repartitionByRange(partitions(docs), F.col("doc_id").asc_nulls_first(), "th")
        .withColumn("part", F.spark_partition_id())
        .dropDuplicates(["part", "doc_id", "th"])
    )
    row = F.struct("doc_id", "th", "packed")
    first = ranged.groupBy("part").agg(F.min_by(row, F.struct("doc_id", "th")).alias("first"))
    # One row for each range: no more than there are partitions.
    turn = Window.orderBy("part")
    ends = first.select(
        "part",
        F.coalesce(F.lead("first").over(turn), F.first("first").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("over"),
    )
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "th")
    following = (
        ranged.withColumn("next", F.lead(row).over(inside))
        .join(F.broadcast(ends), "part")
        .withColumn("next", F.coalesce("next", "over"))
        .select(
            F.col("doc_id").alias("before_id"), F.col("th").alias("before_th"), "n_chars", "packed",
            F.col("next.doc_id").alias("next_id"), F.col("next.th").alias("next_th"),
            likeness(F.col("packed"), F.col("next.packed")).alias("near_next"),
        )
    )
    successors = space.written(following)
    # One key without nulls for both joins and the last grouping, so that texts are dealt out by it once.
    key = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(_NULL_ID))
    plain = texts(docs, id_column, text_column).select(key("doc_id").alias("k"), F.xxhash64("text").alias("th"), "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    after = successors.withColumns({"k": key("next_id"), "th": F.col("next_th")})
    brought = plain.join(after, ["k", "th"]).select(
        key("before_id").alias("k"), F.col("before_id").alias("doc_id"), F.col("before_th").alias("th"), "n_chars", "packed", "near_next", half.alias("half"), F.left("text", half).alias("tail"),
    )
    edited = (
        plain.join(brought, ["k", "th"])
        .dropDuplicates(["k", "th"])
        .select(
            "doc_id", "n_chars", "packed", "near_next",
            F.concat(F.left("text", (F.col("n_chars") - F.col("half")).cast("int")), "tail").alias("edited"),
        )
    )
    return edited.select(
        "doc_id", "n_chars", "packed", "near_next",
        F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_packed"),
    ).select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("packed")).alias("fingerprint"), as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"), "near_next",
    )

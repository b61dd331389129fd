"""Line dedup by content-defined chunks of lines.

A hash that rolls over the lines decides where chunks end, in several chunkings at once:
each has a bit of the hash of its own, and its boundaries are the lines that have the bit set.
A chunk goes from one boundary to the next, both included, so an inserted line shifts no
boundary but those beside it, and of the chunks that begin at a line the shortest is kept.  A chunk
that also stands earlier (smaller id, or earlier in the same document) is removed, after its
bytes were compared with the earlier one's.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.expr import let
from palimpsest.llm.common import marks, may_be_marked, texts
from palimpsest.session import Workspace

#: Chunkings, one for each of the lowest bits of a line's hash.  Two neighbouring lines have no
#: bit in common, and so are no chunk of their own, with probability (3/4)^16: 1 %.
CHUNKINGS = 16
#: Lines with a word that are looked at for the end of a chunk; all lack the bits with probability 1e-16.
LOOK = 8

_WORDED = r"[^\x20\x09-\x0D]"


def _chunks(text: Column) -> Column:
    """For every line with a word the shortest chunk that begins there: first and last line, and the lines as they stand."""
    bits = lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long").bitwiseAND(2**CHUNKINGS - 1)

    def of(lines: Column) -> Column:
        def cut(at: Column) -> Column:
            def with_masks(masks: Column) -> Column:
                def ends(mask: Column, j: Column) -> Column:
                    shared = F.transform(F.slice(masks, j + 2, F.lit(LOOK)), lambda m: m.bitwiseAND(mask) != 0)
                    last = F.get(at, (j + F.array_position(shared, True)).cast("int"))
                    return F.struct(F.get(at, j).alias("first"), last.alias("last"))

                spans = F.filter(F.transform(masks, ends), lambda c: c["last"] > c["first"])
                return F.transform(
                    spans,
                    lambda c: c.withField("body", F.array_join(F.slice(lines, c["first"] + 1, c["last"] - c["first"] + 1), "\n")),
                )

            return let(F.transform(at, lambda i: bits(F.get(lines, i))), with_masks)

        worded = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(_WORDED))
        return let(worded, cut)

    return let(F.split(text, "\n"), of)


def _left(text: Column, removals: Column) -> Column:
    """What is left of a text whose chunks ``removals (j, body)`` go, where they are equal byte for byte."""

    def by_lines(lines: Column, equal: Column) -> Column:
        gone = F.array_distinct(F.flatten(F.transform(equal, lambda c: F.sequence(c["first"], c["last"]))))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.struct(
            F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(gone).cast("long").alias("n_removed_lines"),
            F.size(equal).cast("long").alias("n_removed_chunks"),
        )

    def compared(chunks: Column) -> Column:
        same = F.filter(removals, lambda r: F.get(chunks, r["j"])["body"] == r["body"])
        return F.transform(same, lambda r: F.get(chunks, r["j"]))

    return let(F.split(text, "\n"), lambda lines: let(let(_chunks(text), compared), lambda equal: by_lines(lines, equal)))


def drop_repeated_chunks(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: tuple[str, ...] = (),
    space: Workspace | None = None,
) -> DataFrame:
    """Every document without the multi-line chunks that stand earlier in the table.

    So a run of two or more lines with words that stands earlier goes, but for a pair of neighbours that
    no chunking has in common (1 %); of equal lines the earliest is always left.  What stands
    between the lines of a chunk, lines without a word, belongs to it.

    Only hashes and positions are exchanged to find what repeats; of a repeated chunk one body
    travels, to the documents that have it again, where the bytes are compared.  Turns out that a
    document neither supplies a body nor loses a chunk, its text is not exchanged at all: the
    documents that do are marked in bits that every task has.  Counts combine before the
    exchange, and a chunk that is everywhere is one row on the joins' other side, so its many
    places can be split over tasks.

    Columns named in ``carry`` come along as the struct ``carried``.  Intermediate tables go with ``space``.

    Null and empty texts have no chunk; a null id comes before all others; rows equal
    in id and text are one document; an empty table gives an empty one.  Other
    columns are not looked at.  Returns doc_id, text (what is left), n_lines,
    n_removed_lines, n_removed_chunks.
    """
    space = space or Workspace(docs.sparkSession)
    plain = texts(docs, id_column, text_column).select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = plain.select("doc_id", "th", F.posexplode(_chunks(F.col("text"))).alias("j", "c")).select(
        "doc_id", "th", "j", F.xxhash64("c.body").alias("h"), F.octet_length("c.body").alias("size")
    )
    place = F.struct("doc_id", "th", "j")
    chunks = space.written(found)
    # Written, so that the join deals both sides out for itself and a hot chunk can be split.
    repeated = space.written(
        chunks.groupBy("h", "size").agg(F.min(place).alias("source"), F.max(place).alias("final"))
        .filter(~F.col("source").eqNullSafe(F.col("final")))
        .drop("final")
    )
    again = space.written(
        chunks.join(repeated, ["h", "size"]).filter(~place.eqNullSafe(F.col("source"))).select("doc_id", "th", "j", "h", "size")
    )
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    sources = repeated.select("source.doc_id", "source.th", F.struct("source.j", "h", "size").alias("s"))
    per_source = sources.groupBy("doc_id", "th").agg(F.collect_list("s").alias("s"))
    supplying = may_be_marked(plain, ["doc_id", "th"], marks(sources, ["doc_id", "th"], space)).filter("marked").drop("marked")

    def supplied(c: Column) -> Column:
        return F.transform("s", lambda s: F.struct(s["h"].alias("h"), s["size"].alias("size"), F.get(c, s["j"])["body"].alias("body")))

    bodies = space.written(
        supplying.join(per_source, same(supplying, per_source))
        .select(F.inline(let(_chunks(F.col("text")), supplied)))
        .dropDuplicates(["h", "size"])
    )
    removals = (
        again.join(bodies, ["h", "size"]).groupBy("doc_id", "th").agg(F.collect_set(F.struct("j", "body")).alias("removals"))
    )
    carried = F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(None).cast("string").alias("none"))
    whole = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), carried.alias("carried")
    ).withColumn("th", F.xxhash64("text"))
    whole = may_be_marked(whole, ["doc_id", "th"], marks(again, ["doc_id", "th"], space))
    nothing = F.lit(0).cast("long")
    as_it_is = F.struct(
        "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), nothing.alias("n_removed_lines"), nothing.alias("n_removed_chunks")
    )
    losing = whole.filter("marked")
    touched = losing.join(removals, same(losing, removals), "left").select(
        losing["doc_id"], F.when(F.col("removals").isNull(), as_it_is).otherwise(_left(losing["text"], F.col("removals"))).alias("r"), "carried"
    )
    done = whole.filter(~F.col("marked")).select("doc_id", as_it_is.alias("r"), "carried").unionByName(touched)
    return done.select("doc_id", "r.*", *(["carried"] if carry else []))

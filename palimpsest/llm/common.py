"""What several of the operators share: input columns, words, row keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import Workspace

#: Runs of these separate words: space, tab, line feed, vertical tab, form feed, return.
SEPARATORS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The maximal runs of other characters, in order."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as empty: other columns cannot clash."""
    return docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Bits of one row of marks, as the functions for bitmaps have them.
_ROW = 1 << 15
#: Rows of marks at most: what a task gets of them is never larger than 32 MB.
_ROWS = 1 << 13


def _position(keys: Sequence[str], rows: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(rows * _ROW)) + 1


def marks(keyed: DataFrame, keys: Sequence[str], space: Workspace) -> DataFrame:
    """Bits that say which keys may be in a table: rows ``(rows, bucket, bits)``, of bounded number and size.

    There are eight bits for each row of ``keyed``, up to the bound.  Beyond it more keys are taken for
    marked than are in the table, which costs time and changes no result.
    """
    rows = min(_ROWS, max(1, -(-8 * keyed.count() // _ROW)))
    position = _position(keys, rows)
    bits = keyed.select(F.bitmap_bucket_number(position).alias("bucket"), F.bitmap_bit_position(position).alias("bit"))
    made = bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return space.written(made.withColumn("rows", F.lit(rows)))


def may_be_marked(rows: DataFrame, keys: Sequence[str], marked: DataFrame) -> DataFrame:
    """``rows`` with ``marked``: false only if the key is not in the table that the marks were made of.

    The marks go to every task; their size is bounded where they are made.
    """
    first = marked.agg(F.max("rows")).first()[0]
    if first is None:
        return rows.withColumn("marked", F.lit(False))
    position = _position(keys, first)
    bit = F.bitmap_bit_position(position)
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bits = marked.select(F.col("bucket").alias("_bucket"), "bits")
    flagged = rows.withColumn("_at", F.bitmap_bucket_number(position)).join(F.broadcast(bits), F.col("_at") == F.col("_bucket"), "left")
    found = F.col("bits").isNotNull() & (F.getbit(byte, (bit % 8).cast("int")) == 1)
    return flagged.select(*rows.columns, F.coalesce(found, F.lit(False)).alias("marked"))

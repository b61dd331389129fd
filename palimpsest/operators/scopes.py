"""Numbered tokenization of scopes that span many rows.

A scope such as a conversation may be larger than any one task can hold, so its
rows are never brought together.  Each row is redacted on its own, the distinct
values of all rows are numbered over the scope, and the rows' own tokens are
then exchanged for the scope's.  Texts are looked through once, and only rows with
hits take part in a shuffle.

The result is what redacting the scope's rows one after the other gives: numbers
follow the first appearance by row, then by pattern, then by position.  They start after
the largest that any of the scope's texts has in the category already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.patterns import Pattern
from palimpsest.functions.tokens import has_token, reserved_numbers, token, token_category
from palimpsest.operators.redact import redact
from palimpsest.operators.restore import restore, restore_exact
from palimpsest.operators.stored import part_of
from palimpsest.session import Workspace

# First appearances are ranked within stretches of this many rows of a scope; the
# ranks before a stretch are added up from one count per stretch.
STRETCH_ROWS = 1 << 16


def _row_values(local: DataFrame, scope: str, order: str) -> DataFrame:
    """One row per row and own token, with the value in plain."""
    plain = F.transform(
        "r.values",
        lambda v: F.when(has_token(v), restore(v, F.col("r.tokens"), F.col("r.values"))).otherwise(v),
    )
    pairs = F.arrays_zip(F.col("r.tokens").alias("own"), plain.alias("plain"))
    return local.select(scope, order, F.posexplode(pairs).alias("idx", "p")).select(
        scope, order, "idx", F.col("p.own").alias("own"), F.col("p.plain").alias("plain"), part_of(order).alias("part")
    )


def _taken(rows: DataFrame, scope: str, text: str) -> DataFrame:
    """``(scope, category, taken)``: the largest number of a category that a scope's texts have before they are redacted."""
    numbers = rows.filter(F.contains(F.col(text), F.lit("TG"))).select(scope, F.explode(reserved_numbers(F.col(text))).alias("r"))
    largest = numbers.groupBy(scope, F.col("r.category").alias("category")).agg(F.max("r.n").alias("taken"))
    return largest.select(F.col(scope).alias("taken_of"), F.col("category").alias("taken_category"), "taken")


def _numbered(row_values: DataFrame, scope: str, order: str, taken: DataFrame) -> DataFrame:
    """``(scope, plain, token, parts)``: every distinct value of a scope with its token
    and the parts its rows are in."""
    firsts = (
        row_values.groupBy(scope, "plain")
        .agg(
            F.min(F.struct(F.col(order).alias("at"), "idx", token_category(F.col("own")).alias("category"))).alias("f"),
            F.collect_set("part").alias("parts"),
        )
        .select(
            scope,
            "plain",
            "parts",
            F.col("f.at").alias("at"),
            F.col("f.idx").alias("idx"),
            F.col("f.category").alias("category"),
            F.floor(F.col("f.at") / STRETCH_ROWS).alias("stretch"),
        )
    )
    group = [scope, "category"]
    before = Window.partitionBy(*group).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        firsts.groupBy(*group, "stretch")
        .agg(F.count("*").alias("n"))
        .select(*group, "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        .join(taken, F.col(scope).eqNullSafe(F.col("taken_of")) & (F.col("category") == F.col("taken_category")), "left")
        .select(*group, "stretch", (F.col("before") + F.coalesce("taken", F.lit(0))).alias("offset"))
    )
    within = Window.partitionBy(*group, "stretch").orderBy("at", "idx")
    return (
        firsts.withColumn("rank", F.row_number().over(within))
        .join(offsets, [*group, "stretch"])
        .select(scope, "plain", "parts", token(F.col("category"), F.col("offset") + F.col("rank")).alias("token"))
    )


def redact_scopes(
    df: DataFrame,
    scope: str,
    order: str,
    text: str,
    patterns: Sequence[Pattern] | None = None,
    space: Workspace | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Redact rows that share a mapping per scope.

    ``order`` is a whole number, unique within its scope.  Returns the rows with
    ``redacted`` and ``matches`` added, and the mapping ``(scope, token, category, n,
    value)`` with one row per distinct value of a scope.

    The rows' own results are tables in ``space``, which hold values in clear and go with
    it, or with the session if none is given.
    """
    space = space or Workspace(df.sparkSession)
    local = space.written(df.select("*", redact(text, patterns).alias("r")))
    hits = local.filter(F.size("r.tokens") > 0)
    row_values = space.written(_row_values(hits, scope, order))
    numbered = space.written(_numbered(row_values, scope, order, _taken(local, scope, text)))

    # A value may be in very many rows of a scope: these are dealt out to parts, and the
    # token goes to the parts where its value occurs.
    tokens = numbered.select(scope, "plain", "token", F.explode("parts").alias("part"))
    exchanged = (
        row_values.join(tokens, [scope, "plain", "part"])
        .groupBy(scope, order)
        .agg(F.sort_array(F.collect_list(F.struct("own", "token"))).alias("pairs"))
    )
    changed = hits.join(exchanged, [scope, order]).select(
        *df.columns,
        restore_exact(F.col("r.text"), F.col("pairs.own"), F.col("pairs.token")).alias("redacted"),
        F.col("r.matches").alias("matches"),
    )
    unchanged = local.filter(F.size("r.tokens") == 0).select(
        *df.columns, F.col("r.text").alias("redacted"), F.col("r.matches").alias("matches")
    )
    rows = changed.unionByName(unchanged)
    mapping = numbered.select(
        scope,
        "token",
        token_category(F.col("token")).alias("category"),
        F.regexp_extract("token", r"(\d+)\]$", 1).cast("int").alias("n"),
        F.col("plain").alias("value"),
    )
    return rows, mapping

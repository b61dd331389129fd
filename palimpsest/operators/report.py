"""Reports over redacted text: totals, before/after lines, round-trip checks.

The functions take the struct column that :func:`palimpsest.operators.redact.redact`
returns, so the text is scanned once, whatever is reported.  Generators are the outer
kind with a filter on their output, see :func:`palimpsest.functions.expr.keep_if`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.tokens import tokens_in
from palimpsest.operators.restore import restore

TOTAL = "TOTAL"


def mapping_rows(df: DataFrame, keep: Sequence[str], redacted: str = "redacted") -> DataFrame:
    """The mapping in long form: one row per token, in order of allocation."""
    zipped = F.arrays_zip(F.col(f"{redacted}.tokens").alias("token"), F.col(f"{redacted}.values").alias("value"))
    rows = df.select(*keep, F.posexplode_outer(zipped).alias("ord", "entry")).filter("ord IS NOT NULL")
    return rows.select(
        *keep,
        "ord",
        F.col("entry.token").alias("token"),
        F.split_part("entry.token", F.lit(":"), F.lit(2)).alias("category"),
        F.col("entry.value").alias("value"),
    )


def match_rows(df: DataFrame, keep: Sequence[str], redacted: str = "redacted") -> DataFrame:
    """Match counts in long form: one row per text and pattern that matched."""
    return df.select(*keep, F.inline_outer(f"{redacted}.matches")).filter("pattern IS NOT NULL")


def corpus_summary(df: DataFrame, redacted: str = "redacted") -> DataFrame:
    """Matches per pattern over the corpus, by name, with a total at the end.

    A corpus without matches has no rows, not even a total.
    """
    totals = match_rows(df, [], redacted).rollup("pattern").agg(
        F.sum("n").alias("n"), F.grouping("pattern").alias("is_total")
    )
    name = F.when(F.col("is_total") == 1, F.lit(TOTAL)).otherwise(F.col("pattern"))
    return (
        totals.filter(F.col("n").isNotNull())
        .select(name.alias("pattern"), "n", "is_total")
        .orderBy("is_total", "pattern")
        .drop("is_total")
    )


def changed_lines(
    df: DataFrame, keep: Sequence[str], text: str, redacted: str = "redacted", all_lines: bool = False
) -> DataFrame:
    """Before and after, line by line: the changed lines, or all with a flag.

    Lines are paired by position; a missing line counts as empty.
    """
    before, after = F.col(text), F.col(f"{redacted}.text")
    empty = F.lit("")
    pairs = F.zip_with(
        F.split(before, "\n", -1),
        F.split(after, "\n", -1),
        lambda b, a: F.struct(F.coalesce(b, empty).alias("before"), F.coalesce(a, empty).alias("after")),
    )
    if not all_lines:
        # an unchanged text has no changed lines: do not split it at all
        pairs = F.when(before != after, pairs)
    rows = df.select(*keep, F.posexplode_outer(pairs).alias("line", "pair")).filter("line IS NOT NULL")
    lines = rows.select(
        *keep,
        (F.col("line") + 1).alias("line"),
        F.col("pair.before").alias("before"),
        F.col("pair.after").alias("after"),
        (F.col("pair.before") != F.col("pair.after")).alias("changed"),
    )
    return lines if all_lines else lines.filter("changed").drop("changed")


def round_trips(text: Column, redacted: Column) -> Column:
    """Whether restoring the redacted text gives the text back."""
    return restore(redacted["text"], redacted["tokens"], redacted["values"]) == text


def unresolved_rows(texts: DataFrame, scope: Sequence[str], text: str, mapping: DataFrame) -> DataFrame:
    """Tokens in texts that a long-form mapping lacks: one row per scope and token,
    with the number of times it occurs.

    Counting comes before the join, so a token that fills a corpus is one row in it.
    """
    found = texts.select(*scope, F.explode_outer(tokens_in(F.col(text))).alias("token")).filter("token IS NOT NULL")
    counted = found.groupBy(*scope, "token").agg(F.count("*").alias("n"))
    return counted.join(mapping.select(*scope, "token"), [*scope, "token"], "left_anti")

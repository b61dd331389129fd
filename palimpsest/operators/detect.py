"""Finding values without rewriting: hits and counts per pattern on the text as it is.

The generators are the outer kind with a filter on their output, see
:func:`palimpsest.functions.expr.keep_if`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.patterns import Pattern, default_patterns
from palimpsest.operators.redact import can_match, java_form, with_shared_gates


def find_values(text: Column, p: Pattern) -> Column:
    """All values one pattern finds in a text, in order."""
    regex, group = java_form(p)
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def _found(text: Column, patterns: Sequence[Pattern]) -> Column:
    """``array<struct<pattern, category, found>>`` of the patterns with hits."""

    def entries(gates: Column) -> Column:
        tested = (
            F.when(
                can_match(text, gates, p),
                F.struct(
                    F.lit(p.name).alias("pattern"),
                    F.lit(p.category).alias("category"),
                    find_values(text, p).alias("found"),
                ),
            )
            for p in patterns
        )
        return F.filter(F.array_compact(F.array(*tested)), lambda e: F.size(e["found"]) > 0)

    return with_shared_gates(text, entries)


def hits(df: DataFrame, text: str, keep: Sequence[str], patterns: Sequence[Pattern] | None = None) -> DataFrame:
    """One row per match: the kept columns, ``pattern``, ``category``, ``pos`` (from 0,
    within the pattern) and ``value``.  Each pattern looks at the original text."""
    patterns = default_patterns() if patterns is None else patterns
    per_pattern = df.select(*keep, F.inline_outer(_found(F.col(text), patterns))).filter("pattern IS NOT NULL")
    return per_pattern.select(*keep, "pattern", "category", F.posexplode_outer("found").alias("pos", "value"))


def count_by_pattern(df: DataFrame, text: str, patterns: Sequence[Pattern] | None = None) -> DataFrame:
    """Matches and texts with matches per pattern, over the original texts."""
    patterns = default_patterns() if patterns is None else patterns
    per_text = df.select(F.inline_outer(_found(F.col(text), patterns))).filter("pattern IS NOT NULL")
    per_text = per_text.select("pattern", F.size("found").alias("n"))
    return per_text.groupBy("pattern").agg(F.sum("n").alias("matches"), F.count("*").alias("texts"))

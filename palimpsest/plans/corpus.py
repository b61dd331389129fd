"""The corpus job: redact every text of a table and keep what is needed to undo it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.patterns import Pattern
from palimpsest.operators.redact import match_total, redact
from palimpsest.operators.rules import RuleSet


def redact_corpus(
    df: DataFrame, text: str, keep: Sequence[str], patterns: Sequence[Pattern] | RuleSet | None = None
) -> DataFrame:
    """One row per text with the kept columns, the text, and the ``redacted`` struct.

    One pass without a shuffle.  ``patterns`` may be a rule set, whose toggles then
    choose the patterns.
    """
    if isinstance(patterns, RuleSet):
        patterns = patterns.enabled_patterns()
    return df.select(*keep, F.col(text), redact(text, patterns).alias("redacted"))


def redacted_texts(corpus: DataFrame, keep: Sequence[str]) -> DataFrame:
    """What may be handed on: the redacted text and how much was replaced."""
    return corpus.select(
        *keep,
        F.col("redacted.text").alias("text"),
        match_total(F.col("redacted.matches")).alias("matches"),
        F.size("redacted.tokens").alias("values"),
    )

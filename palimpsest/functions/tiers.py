"""The ordered tiers: a higher code is more restricted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PUBLIC, REDACTED, LOCAL_ONLY, BLOCKED = 0, 1, 2, 3
TIER_NAMES = ("public", "redacted", "local-only", "blocked")
TIER_WORDS = {
    "block": BLOCKED,
    "blocked": BLOCKED,
    "local-only": LOCAL_ONLY,
    "localonly": LOCAL_ONLY,
    "local": LOCAL_ONLY,
    "redact": REDACTED,
    "redacted": REDACTED,
    "public": PUBLIC,
    "pass": PUBLIC,
    "allow": PUBLIC,
}
# End of fixed values.


def tier_name(tier: Column) -> Column:
    return F.coalesce(F.get(F.array(*(F.lit(n) for n in TIER_NAMES)), tier), F.lit("unknown"))


def tier_of_word(word: str) -> int | None:
    """The tier a rule's tier word stands for, None if it stands for nothing."""
    return TIER_WORDS.get(word.strip().lower())


def escalate(a: Column, b: Column) -> Column:
    """The more restricted of two tiers."""
    return F.greatest(a, b)

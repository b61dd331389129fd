"""The token format and tests on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token format is part of the stored data.
TOKEN_PREFIX = "[TG:"
TOKEN_REGEX = r"\[TG:[A-Z]+:[0-9]+\]"
# End of fixed values.

# A token has at most so many characters: frame, category and a number of ten digits.
MAX_TOKEN = 64
MAX_CATEGORY = MAX_TOKEN - len("[TG::]") - 10


def token(category: Column, number: Column) -> Column:
    return F.concat(F.lit(TOKEN_PREFIX), category, F.lit(":"), number.cast("string"), F.lit("]"))


def has_token(text: Column) -> Column:
    """Whether a text may contain tokens."""
    return F.contains(text, F.lit(TOKEN_PREFIX))


def token_category(tok: Column) -> Column:
    return F.split_part(tok, F.lit(":"), F.lit(2))


def token_number(tok: Column) -> Column:
    return F.rtrim(F.split_part(tok, F.lit(":"), F.lit(3)), F.lit("]")).cast("int")


def tokens_in(text: Column) -> Column:
    """All well-formed tokens of a text, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(TOKEN_REGEX), F.lit(0))


# A token or one of the spellings that are restored as well; longer numbers are never handed out.
_SPELLED = r"TG[:_]([A-Z]+)[:_]([0-9]{1,9})(?![0-9])"
RESERVED = "array<struct<category:string,n:int>>"


def reserved_numbers(text: Column) -> Column:
    """``array<struct<category, n>>``: what in a text looks like a token before it has any."""
    categories, numbers = (F.regexp_extract_all(text, F.lit(_SPELLED), F.lit(g)) for g in (1, 2))
    pair = F.zip_with(categories, numbers, lambda c, n: F.struct(c.alias("category"), n.cast("int").alias("n")))
    return F.when(F.contains(text, F.lit("TG")), pair).otherwise(F.array().cast(RESERVED))


def last_reserved(reserved: Column, category: Column) -> Column:
    """The largest number that is taken in a category, or 0: new tokens are numbered after it."""
    own = F.filter(reserved, lambda r: r["category"] == category)
    return F.coalesce(F.array_max(F.transform(own, lambda r: r["n"])), F.lit(0))

"""Putting the original values back.

A mapping is a pair of parallel arrays ``tokens`` and ``values``, as the redact
operators return it.  Every function here finds the tokens of a text in one pass
and looks them up, so the cost grows with the text and not with text x mapping.
Where one mapping serves many texts, its lookup table (``functions/expr.py``) may be
given as well, and is not built again for each of them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from string import ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.expr import let, split_at, with_lookup
from palimpsest.functions.tokens import TOKEN_REGEX, has_token, token_category, tokens_in

# Rounds for values that embed tokens which embed tokens ..., in any order.  What is
# nested deeper is undone in the reverse order of allocation, which always ends.
MAX_NESTING = 10

# A JSON string with its quotes; possessive, so that a long one needs no deep stack.
_JSON_STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_QUOTE = "[\"'`]?"


def _replace_tokens(text: Column, find) -> Column:
    """Replace each known token once; values are not looked into."""
    gaps = split_at(text, TOKEN_REGEX)
    return let(
        F.struct(gaps.alias("gaps"), tokens_in(text).alias("toks")),
        lambda p: F.array_join(
            F.zip_with(
                p["gaps"],
                p["toks"],
                lambda gap, tok: F.when(tok.isNull(), gap).otherwise(F.concat(gap, F.coalesce(find(tok), tok))),
            ),
            "",
        ),
    )


def restore_exact(text: Column, tokens: Column, values: Column, table: Column | None = None) -> Column:
    """Replace every known token by its value, in one pass.

    Tokens inside restored values stay; unknown tokens stay.
    """
    return F.when(
        has_token(text) & (F.size(tokens) > 0),
        with_lookup(tokens, values, lambda find: _replace_tokens(text, find), table),
    ).otherwise(text)


def restore(text: Column, tokens: Column, values: Column, table: Column | None = None) -> Column:
    """Replace every known token by its value, including tokens inside values.

    The inverse of redaction.  Each round undoes one level of nesting and a text
    without tokens left costs nothing more.  A value embeds tokens allocated before its
    own, so nesting deeper than the rounds is undone from the last such value to the first.
    """

    def deeper(t: Column, nesting: Column, find) -> Column:
        def put_back(done: Column, at: Column) -> Column:
            return F.replace(done, F.get(tokens, at), F.get(values, at))

        return _replace_tokens(F.aggregate(F.reverse(nesting), t, put_back), find)

    def rounds(find) -> Column:
        undone = F.aggregate(
            F.sequence(F.lit(0), F.lit(MAX_NESTING)),
            text,
            lambda t, _: F.when(has_token(t), _replace_tokens(t, find)).otherwise(t),
        )
        indexes = F.sequence(F.lit(0), F.size(tokens) - 1)
        nesting = F.filter(indexes, lambda i: has_token(F.get(values, i)))
        return let(
            undone,
            lambda t: F.when(
                has_token(t),
                let(nesting, lambda n: F.when(F.size(n) > MAX_NESTING, deeper(t, n, find)).otherwise(t)),
            ).otherwise(t),
        )

    return F.when(
        has_token(text) & (F.size(tokens) > 0), with_lookup(tokens, values, rounds, table)
    ).otherwise(text)


def categories_of(tokens: Column) -> Column:
    """The categories of a mapping, in alphabetical order."""
    return F.array_sort(F.array_distinct(F.transform(tokens, token_category)))


def _spells(text: Column, category: Column) -> Column:
    """Whether a spelling of the category's tokens may be in the text."""
    plain = F.translate(category, ascii_uppercase, "") == ""
    found = reduce(or_, (F.contains(text, F.concat(F.lit(f"TG{sep}"), category)) for sep in ":_"))
    return F.when(plain, found).otherwise(text.rlike("TG[:_]"))


def restore_fuzzy(
    text: Column, tokens: Column, values: Column, table: Column | None = None, categories: Column | None = None
) -> Column:
    """Exact restore, then the spellings a model tends to turn tokens into.

    ``TG:CAT:N`` and ``TG_CAT_N``, bare or in quotes or backticks, are replaced
    (with their quotes) if ``[TG:CAT:N]`` is known.  Categories are taken in
    alphabetical order.
    """

    def one_category(t: Column, category: Column, find) -> Column:
        regex = F.concat(F.lit(f"{_QUOTE}TG[:_]"), category, F.lit(f"[:_]([0-9]+){_QUOTE}"))
        parts = F.struct(
            F.split(t, regex, -1).alias("gaps"),
            F.regexp_extract_all(t, regex, F.lit(0)).alias("spelled"),
        )

        def with_gap(p: Column, gap: Column, i: Column) -> Column:
            spelled = F.get(p["spelled"], i)
            number = F.regexp_extract(spelled, rf"([0-9]+){_QUOTE}\z", 1)
            known = find(F.concat(F.lit("[TG:"), category, F.lit(":"), number, F.lit("]")))
            return F.concat(gap, F.coalesce(known, spelled, F.lit("")))

        return let(parts, lambda p: F.array_join(F.transform(p["gaps"], lambda gap, i: with_gap(p, gap, i)), ""))

    def both(find) -> Column:
        exact = F.when(has_token(text), _replace_tokens(text, find)).otherwise(text)
        return F.aggregate(
            categories_of(tokens) if categories is None else categories,
            exact,
            # a category's regex is compiled for the text, so only where its spelling is
            lambda t, c: F.when(_spells(t, c), one_category(t, c, find)).otherwise(t),
        )

    return (
        F.when(F.size(tokens) == 0, text)
        .when(text.rlike("TG[:_]"), with_lookup(tokens, values, both, table))
        .otherwise(text)
    )


def restore_json(body: Column, tokens: Column, values: Column, restorer=restore) -> Column:
    """Restore the string values of a JSON object at any depth, keys untouched.

    Restored values are escaped again, so the result stays valid JSON.  A body
    that is not a JSON object is restored as plain text.
    """

    def encoded(value: Column) -> Column:
        # {"v":"..."} without its frame
        return let(F.to_json(F.struct(value.alias("v"))), lambda e: F.substr(e, F.lit(6), F.length(e) - 6))

    def string_value(raw: Column) -> Column:
        decoded = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
        return let(
            decoded,
            lambda d: let(restorer(d, tokens, values), lambda r: F.when(r != d, encoded(r)).otherwise(raw)),
        )

    def piece(p: Column, gap: Column, i: Column) -> Column:
        raw = F.get(p["strings"], i)
        is_key = F.get(p["gaps"], i + 1).rlike(r"\A\s*:")
        kept = F.when(F.contains(raw, F.lit("TG")) & ~is_key, string_value(raw)).otherwise(raw)
        return F.concat(gap, F.coalesce(kept, F.lit("")))

    # in valid JSON a quote is either escaped or an end of a string
    parts = F.struct(
        F.split(body, _JSON_STRING, -1).alias("gaps"),
        F.regexp_extract_all(body, F.lit(_JSON_STRING), F.lit(0)).alias("strings"),
    )
    rebuilt = let(parts, lambda p: F.array_join(F.transform(p["gaps"], lambda gap, i: piece(p, gap, i)), ""))
    is_object = F.startswith(F.schema_of_variant(F.try_parse_json(body)), F.lit("OBJECT"))
    return (
        F.when((F.size(tokens) == 0) | ~F.contains(body, F.lit("TG")), body)
        .when(is_object, rebuilt)
        .otherwise(restorer(body, tokens, values))
    )


def restore_event_line(line: Column, tokens: Column, values: Column) -> Column:
    """Restore the data lines of an event stream; control lines stay."""
    return F.when(F.startswith(line, F.lit("data:")) & (F.length(line) >= 6), restore_fuzzy(line, tokens, values)).otherwise(line)


def unresolved_tokens(text: Column, tokens: Column) -> Column:
    """The tokens of a text that the mapping does not have, repeats kept."""

    def missing(find) -> Column:
        return F.filter(tokens_in(text), lambda t: find(t).isNull())

    return F.when(has_token(text), with_lookup(tokens, tokens, missing)).otherwise(F.array().cast("array<string>"))


def sanitize_for_log(text: Column) -> Column:
    """Tokens never show values, so a tokenized text may be logged as it is."""
    return text

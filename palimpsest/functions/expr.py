"""Small building blocks for long Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Below this many keys a straight scan of the key array beats a binary search.
_SCAN_LIMIT = 32
# A binary search over 2^31 entries, the longest array there is, ends within 32 steps.
_SEARCH_STEPS = 32

EMPTY_STRINGS = "array<string>"
# Stands for what a text is split at.
_CUT = "\ue004"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    An aggregation over no elements: its start value goes to its last step as it is,
    where ``transform`` over one element would copy it.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def no_strings() -> Column:
    return F.array().cast(EMPTY_STRINGS)


def split_at(text: Column, regex: str) -> Column:
    """``split`` without a limit at a regex that matches no empty text.

    ``split`` compiles its regex for every text, replacing does so once; a single character needs no regex.
    A text that has this character already is split by the regex.
    """
    cut = lambda t: F.split(F.regexp_replace(t, F.lit(regex), F.lit(_CUT)), _CUT, -1)
    return let(text, lambda t: F.when(F.contains(t, F.lit(_CUT)), F.split(t, regex, -1)).otherwise(cut(t)))


def lookup_table(keys: Column, values: Column) -> Column:
    """The sorted table that :func:`with_lookup` searches; empty for few keys, which it scans.

    A mapping that serves many rows has it worked out once, beside its arrays.
    """
    # the position decides between equal keys, as it does in a scan
    placed = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    entry = lambda at, v: F.struct(at["k"].alias("k"), at["i"].alias("i"), v.alias("v"))
    return F.when(F.size(keys) <= _SCAN_LIMIT, F.array().cast("array<struct<k:string,i:int,v:string>>")).otherwise(
        F.sort_array(F.zip_with(placed, values, entry))
    )


def with_lookup(
    keys: Column, values: Column, body: Callable[[Callable[[Column], Column]], Column], table: Column | None = None
) -> Column:
    """Run ``body`` with a function that finds a key's value (NULL if absent).

    ``keys`` and ``values`` are parallel arrays; of equal keys the first counts.  Few keys are scanned.  Many are
    sorted once and searched by halving, so that a text with a million distinct
    values costs n log n and not n squared.  ``table`` is their :func:`lookup_table`
    if it is at hand.
    """

    def with_table(table: Column) -> Column:
        size = F.size(table)

        def search(key: Column) -> Column:
            def halve(bounds: Column, _: Column) -> Column:
                mid = F.floor((bounds["lo"] + bounds["hi"]) / 2).cast("int")
                below = F.element_at(table, mid)["k"] < key
                return F.when(
                    bounds["lo"] < bounds["hi"],
                    F.struct(
                        F.when(below, mid + 1).otherwise(bounds["lo"]).alias("lo"),
                        F.when(below, bounds["hi"]).otherwise(mid).alias("hi"),
                    ),
                ).otherwise(bounds)

            start = F.struct(F.lit(1).alias("lo"), size.alias("hi"))
            steps = F.sequence(F.lit(1), F.least(F.lit(_SEARCH_STEPS), F.ceil(F.log2(size)).cast("int") + 1))
            found = F.aggregate(steps, start, halve)
            return let(
                F.element_at(table, found["lo"]),
                lambda entry: F.when(entry["k"] == key, entry["v"]),
            )

        def scan(key: Column) -> Column:
            return F.get(values, F.array_position(keys, key).cast("int") - 1)

        return F.when(size == 0, body(scan)).otherwise(body(search))

    return let(lookup_table(keys, values), with_table) if table is None else with_table(table)


def keep_if(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that fulfil a condition on a costly column, which is worked out once.

    A plain filter would be pushed below the projection, and the column's whole
    expression be evaluated for the filter and again for the output.  A filter on
    the output of a generator stays where it is.  ``explode`` itself gets a filter
    on its input for the same reason, ``explode_outer`` does not.
    """
    kept = F.explode_outer(F.when(condition, F.array(F.lit(True))))
    return df.select("*", kept.alias("_kept")).filter("_kept").drop("_kept")

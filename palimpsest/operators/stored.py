"""Putting values back from a mapping that is stored in long form.

``report.mapping_rows`` and ``scopes.redact_scopes`` give such a mapping: one row per
scope and token.  A scope may have any number of rows and values, so nothing of it is
brought together but the tokens that one text has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.tokens import has_token, tokens_in
from palimpsest.operators.restore import restore_exact
from palimpsest.session import Workspace

# Tasks that the rows with one and the same token are spread over.
SPREAD = 32


def part_of(*key: str) -> Column:
    """The part, of ``SPREAD``, in which a row meets the tokens it has."""
    return F.pmod(F.xxhash64(*key), F.lit(SPREAD)).cast("int")


def _put_back(rows: DataFrame, key: Sequence[str], scope: Sequence[str], text: str, mapping: DataFrame, below: bool = False) -> DataFrame:
    """``rows`` with the known tokens of ``text`` replaced once; ``below``: by entries with a smaller ``ord`` only."""
    order = ["ord"] if below else []
    with_tokens = rows.filter(has_token(F.col(text)))
    found = with_tokens.select(
        *key, *order, part_of(*key).alias("_part"), F.explode(F.array_distinct(tokens_in(F.col(text)))).alias("_token")
    )
    # A token that fills a scope goes to the parts where it occurs, at most SPREAD of them.
    wanted = found.select(*scope, "_token", "_part").distinct()
    entries = mapping.select(
        *(F.col(c).alias(f"_of_{c}") for c in scope), F.col("token").alias("_known"), F.col("value").alias("_value"),
        *(F.col(c).alias("_ord") for c in order),
    )
    of_scope = F.col("_token") == F.col("_known")
    for c in scope:
        of_scope &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    dealt = wanted.join(entries, of_scope).select(*(f"_of_{c}" for c in scope), F.col("_part").alias("_at"), "_known", "_value", *(["_ord"] if below else []))
    met = of_scope & (F.col("_part") == F.col("_at"))
    if below:
        met &= F.col("_ord") < F.col("ord")
    pairs = found.join(dealt, met).groupBy(*key).agg(F.collect_list(F.struct("_known", "_value")).alias("_pairs"))
    pairs = pairs.select(*(F.col(c).alias(f"_of_{c}") for c in key), "_pairs")
    own = F.lit(True)
    for c in key:
        own &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    done = restore_exact(F.col(text), F.col("_pairs._known"), F.col("_pairs._value"))
    back = with_tokens.join(pairs, own, "left").select(
        *(F.when(F.col("_pairs").isNull(), F.col(c)).otherwise(done).alias(c) if c == text else c for c in rows.columns)
    )
    return rows.filter(~F.coalesce(has_token(F.col(text)), F.lit(False))).unionByName(back)


def resolved_mapping(mapping: DataFrame, scope: Sequence[str], space: Workspace | None = None) -> DataFrame:
    """A long-form mapping whose values have no tokens of the mapping in them any more.

    A value embeds tokens allocated before its own, so entries with a smaller ``ord`` are
    put in until no value changes.  Every round doubles the depth that is undone, and
    only values with tokens take part.
    """
    space = space or Workspace(mapping.sparkSession)
    key = [*scope, "token"]
    columns = [*key, "ord", "value"]
    entries = mapping.select(*columns)
    plain = entries.filter(~has_token(F.col("value")))
    nested = space.written(entries.filter(has_token(F.col("value"))))
    while not nested.isEmpty():
        done = space.written(
            _put_back(nested.withColumn("_was", F.col("value")), key, scope, "value", plain.unionByName(nested), below=True)
        )
        changed = not done.filter(F.col("value") != F.col("_was")).isEmpty()
        nested = done.select(*columns)
        if not changed:
            break
    return plain.unionByName(nested)


def restore_stored(
    texts: DataFrame, key: Sequence[str], text: str, mapping: DataFrame, scope: Sequence[str] | None = None,
    space: Workspace | None = None,
) -> DataFrame:
    """Redacted texts with the values of a stored long-form mapping, at any depth.

    ``key`` tells the texts apart; ``scope`` (by default the key) are those of its columns
    that the mapping has.  A mapping with a column ``ord``, as of ``report.mapping_rows``,
    may have tokens in its values; one without, as of ``redact_scopes``, has plain values.
    Tokens the mapping lacks stay, null texts too; texts without tokens are not shuffled.
    """
    scope = list(key if scope is None else scope)
    if "ord" in mapping.columns:
        mapping = resolved_mapping(mapping, scope, space)
    return _put_back(texts, key, scope, text, mapping)

"""Numbered tokenization of scopes whose rows arrive over time.

Each row is redacted by the batch expression.  What goes on from one micro-batch to the
next is, for every scope, the token of each value and the last number of each category:
keyed state, entry by entry, of which a row reads no more than its own values.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from palimpsest.functions.patterns import Pattern
from palimpsest.functions.tokens import has_token, reserved_numbers, token_category
from palimpsest.operators.redact import redact
from palimpsest.operators.restore import restore, restore_exact
from palimpsest.operators.stored import SPREAD, part_of
from palimpsest.session import settings

#: State with entries of its own needs this store; a session uses one for all its streams.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
# The part of rows with values; those without need no state and are spread over the others.
_STATEFUL = -1
_PASSED = "scope string, seq bigint, text string, matches string"
_NUMBERED = f"{_PASSED}, own array<string>, tokens array<string>, fresh array<struct<token:string,value:string>>"


class _Numbers(StatefulProcessor):
    """Hands out a scope's tokens in the order of its rows."""

    def init(self, handle) -> None:
        self.tokens = handle.getMapState("tokens", "value string", "token string")
        self.last = handle.getMapState("last", "category string", "n bigint")

    def _take(self, category: str, after: int) -> int:
        n = max(after, self.last.getValue((category,))[0] if self.last.containsKey((category,)) else 0)
        return n

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        columns = ["scope", "seq", "text", "matches"]
        if key[1] != _STATEFUL:
            yield batch[columns].assign(own=None, tokens=None, fresh=None)
            return
        batch = batch.sort_values("seq", kind="stable")
        known: dict[str, str] = {}
        last: dict[str, int] = {}
        for categories, numbers in zip(batch["taken"], batch["numbers"]):
            for category, n in zip(categories, numbers):
                last[category] = max(self._take(category, int(n)), last.get(category, 0))
        changed = set(last)
        all_tokens, all_fresh = [], []
        for plain, categories in zip(batch["plain"], batch["categories"]):
            tokens, fresh = [], []
            for value, category in zip(plain, categories):
                token = known.get(value)
                if token is None and self.tokens.containsKey((value,)):
                    token = self.tokens.getValue((value,))[0]
                if token is None:
                    if category not in last:
                        last[category] = self._take(category, 0)
                    last[category] += 1
                    changed.add(category)
                    token = f"[TG:{category}:{last[category]}]"
                    self.tokens.updateValue((value,), (token,))
                    fresh.append({"token": token, "value": value})
                known[value] = token
                tokens.append(token)
            all_tokens.append(tokens)
            all_fresh.append(fresh)
        for category in changed:
            self.last.updateValue((category,), (last[category],))
        yield batch[[*columns, "own"]].assign(tokens=all_tokens, fresh=all_fresh)

    def close(self) -> None:
        pass


# The process that keeps a stream's state gets the processor as it is, and need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def redact_scopes_stream(
    stream: DataFrame, scope: str, order: str, text: str, patterns: Sequence[Pattern] | None = None
) -> DataFrame:
    """Redact rows of a stream that share a mapping per scope, across micro-batches and restarts.

    ``order`` is a whole number, unique within its scope.  Returns the scope, ``order``, ``redacted``,
    ``matches`` and ``fresh``: the tokens that came up with the row first, with their values in
    plain.  All rows' ``fresh`` together are the mapping of the scope.

    Rows of a scope that arrive in order get what :func:`palimpsest.operators.scopes.redact_scopes`
    gives for the whole table.  A row that arrives late gets numbers after those that are handed
    out.  A token once given stays with its value: state has no time limit, and holds one entry for
    each distinct value.  What a row has that looks like a token is never handed out from the
    batch it comes in on.

    A task holds the rows with values that one scope has in one micro-batch; limit the files of a batch if
    scopes come in large pieces.  Rows without values go by without state.  Start the query
    within ``settings(spark, STATE_STORE)``, as :func:`run_scopes` does.
    """
    kind = stream.schema[scope].dataType
    r = F.col("r")
    plain = F.transform(r["values"], lambda v: F.when(has_token(v), restore(v, r["tokens"], r["values"])).otherwise(v))
    reserved = F.col("reserved")
    local = stream.select(
        F.col(scope).cast("string").alias("scope"),
        F.col(order).cast("bigint").alias("seq"),
        redact(text, patterns).alias("r"),
        F.coalesce(reserved_numbers(F.col(text)), F.array()).alias("reserved"),
    )
    idle = (F.size(F.coalesce(r["tokens"], F.array())) == 0) & (F.size("reserved") == 0)
    rows = local.select(
        "scope", "seq", r["text"].alias("text"), F.to_json(r["matches"]).alias("matches"), r["tokens"].alias("own"),
        plain.alias("plain"), F.transform(r["tokens"], token_category).alias("categories"),
        F.transform(reserved, lambda x: x["category"]).alias("taken"), F.transform(reserved, lambda x: x["n"]).alias("numbers"),
        F.when(idle, part_of("scope", "seq")).otherwise(_STATEFUL).alias("part"),
        F.when(~idle, F.coalesce("scope", F.lit(""))).otherwise("").alias("key"), (F.col("scope").isNull() & ~idle).alias("none"),
    )
    numbered = rows.groupBy("key", "part", "none").transformWithStateInPandas(
        _Numbers(), outputStructType=_NUMBERED, outputMode="Append", timeMode="None"
    )
    exchanged = F.when(F.size("tokens") > 0, restore_exact(F.col("text"), F.col("own"), F.col("tokens"))).otherwise(F.col("text"))
    return numbered.select(
        F.col("scope").cast(kind).alias(scope),
        F.col("seq").alias(order),
        exchanged.alias("redacted"),
        F.from_json("matches", "array<struct<pattern:string,n:int>>").alias("matches"),
        F.coalesce("fresh", F.array()).alias("fresh"),
    )


def run_scopes(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Write what is there to Parquet and stop; the next run goes on with the numbers of this one."""
    from palimpsest.streaming.streams import run_available

    with settings(stream.sparkSession, STATE_STORE):
        run_available(stream, output, checkpoint)


def stream_mapping(rows: DataFrame, scope: str) -> DataFrame:
    """The mapping ``(scope, token, category, n, value)`` from the rows that a stream has written."""
    entries = rows.select(scope, F.explode("fresh").alias("e"))
    return entries.select(
        scope,
        F.col("e.token").alias("token"),
        token_category(F.col("e.token")).alias("category"),
        F.regexp_extract("e.token", r"(\d+)\]$", 1).cast("int").alias("n"),
        F.col("e.value").alias("value"),
    )

"""The audit table: entries, queries and summaries.

Columns: ``id, ts, agent, provider, action, target, tier, redactions, approved,
notes`` and the partition column ``date``.  ``redactions`` is a JSON object of
matches per pattern.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.restore import unresolved_tokens

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("agent", T.StringType(), False),
        T.StructField("provider", T.StringType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("target", T.StringType()),
        T.StructField("tier", T.StringType(), False),
        T.StructField("redactions", T.StringType()),
        T.StructField("approved", T.BooleanType()),
        T.StructField("notes", T.StringType()),
    ]
)

DEFAULT_LIMIT, MAX_LIMIT = 100, 10_000

_UNIT_SECONDS = {"h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}
_DURATION = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:h|ms|m|s|us|µs|ns))+")


def parse_since(text: str, now: dt.datetime) -> dt.datetime | None:
    """The moment a duration like ``2h``, ``1h30m`` or ``7d`` ago.

    Empty means no bound (None); anything unreadable means 24 hours.
    """
    if not text:
        return None
    day = dt.timedelta(days=1)
    days = re.fullmatch(r"([+-]?\d+)d", text)
    if days:
        return now - int(days.group(1)) * day
    if text == "0":
        return now
    if not _DURATION.fullmatch(text):
        return now - day
    seconds = sum(
        float(n) * _UNIT_SECONDS[unit] for n, unit in re.findall(r"(\d+\.?\d*|\.\d+)(h|ms|m|s|us|µs|ns)", text)
    )
    return now - dt.timedelta(seconds=-seconds if text[0] == "-" else seconds)


def utc_date(moment: Column) -> Column:
    """The date in UTC, whatever the session's time zone."""
    days = F.floor(F.unix_seconds(moment) / 86400).cast("int")
    return F.date_add(F.lit(dt.date(1970, 1, 1)), days)


def entries(
    audit: DataFrame, agent: str = "", since: dt.datetime | None = None, until: dt.datetime | None = None
) -> DataFrame:
    """The entries of an agent and a period; no agent and no bound means all.

    The bounds go on ``date`` as well where the table has it, so that whole
    partitions are left out.
    """
    if agent:
        audit = audit.filter(F.col("agent") == agent)
    for bound, at_least in ((since, True), (until, False)):
        if bound is None:
            continue
        column, day = F.col("ts"), utc_date(F.lit(bound))
        audit = audit.filter(column >= bound if at_least else column <= bound)
        if "date" in audit.columns:
            # A day more: a table from elsewhere may have its dates in another time zone.
            audit = audit.filter(F.col("date") >= F.date_sub(day, 1) if at_least else F.col("date") <= F.date_add(day, 1))
    return audit


def recent(audit: DataFrame, agent: str = "", since: dt.datetime | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest entries first.  A limit outside 1 to 10000 means 100."""
    limit = limit if 0 < limit <= MAX_LIMIT else DEFAULT_LIMIT
    return entries(audit, agent, since).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def all_entries(audit: DataFrame, agent: str = "", since: dt.datetime | None = None) -> DataFrame:
    """Every matching entry, the newest first."""
    return entries(audit, agent, since).orderBy(F.desc("ts"), F.desc("id"))


def has_redactions(redactions: Column) -> Column:
    return F.coalesce((redactions != "") & (redactions != "null"), F.lit(False))


def summary(audit: DataFrame, since: dt.datetime | None = None) -> DataFrame:
    """Entry counts by tier, by agent, by provider and in total, in long form.

    ``dimension`` is ``tier``, ``agent``, ``provider`` or ``total``; ``redacted`` counts
    entries with redactions.  All matching entries are counted, by combination first,
    so that only the few combinations are multiplied for the groupings.
    """
    combos = (
        entries(audit, since=since)
        .groupBy("tier", "agent", "provider")
        .agg(F.count("*").alias("n"), F.count_if(has_redactions(F.col("redactions"))).alias("r"))
    )
    sums = (F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.coalesce(F.sum("r"), F.lit(0)).alias("redacted"))
    grouped = combos.groupingSets([["tier"], ["agent"], ["provider"]], "tier", "agent", "provider").agg(
        *sums, F.grouping_id().alias("g")
    )
    # grouping ids: a bit is set for each column that is NOT part of the grouping
    dimension = F.when(F.col("g") == 0b011, "tier").when(F.col("g") == 0b101, "agent").otherwise("provider")
    # the total is there even without entries, which no grouping set gives
    total = combos.agg(*sums).select(F.lit("total").alias("dimension"), F.lit("").alias("key"), "entries", "redacted")
    return grouped.select(
        dimension.alias("dimension"), F.coalesce("tier", "agent", "provider").alias("key"), "entries", "redacted"
    ).unionByName(total)


def redaction_totals(audit: DataFrame, since: dt.datetime | None = None) -> DataFrame:
    """Matches per pattern over all entries, out of their JSON."""
    counts = F.from_json("redactions", "map<string,bigint>")
    return (
        entries(audit, since=since)
        .filter(has_redactions(F.col("redactions")))
        .select(F.explode_outer(counts).alias("pattern", "n"))
        .filter("pattern IS NOT NULL")
        .groupBy("pattern")
        .agg(F.sum("n").alias("matches"), F.count("*").alias("entries"))
    )


#: What an entry about a token that no mapping has is called.
UNRESOLVED = "unresolved_token"


def unresolved_entries(
    unresolved: DataFrame, scope: Sequence[str], agent: Column | str = "unknown", provider: Column | str = "unknown",
    ts: Column | None = None,
) -> DataFrame:
    """Audit entries for tokens that could not be restored, one for each scope and token.

    ``unresolved`` has the scope's columns, ``token`` and ``n``, as of :func:`palimpsest.operators.report.unresolved_rows`
    or :func:`unresolved_of_rows`.  The id follows from scope and token, so an entry made twice is the same entry.
    """
    as_column = lambda c: F.lit(c) if isinstance(c, str) else c
    # Lengths keep neighbouring values apart, a null is no value.
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in [*scope, "token"]]
    return unresolved.select(
        F.sha2(F.concat_ws("|", *parts), 256).alias("id"),
        (F.lit(None).cast("timestamp") if ts is None else ts).alias("ts"),
        as_column(agent).alias("agent"),
        as_column(provider).alias("provider"),
        F.lit(UNRESOLVED).alias("action"),
        F.col("token").alias("target"),
        F.lit("redacted").alias("tier"),
        F.lit(None).cast("string").alias("redactions"),
        F.lit(False).alias("approved"),
        F.concat(F.col("n").cast("string"), F.lit(" left in place")).alias("notes"),
    )


def unresolved_of_rows(rows: DataFrame, scope: Sequence[str], text: str, tokens: str) -> DataFrame:
    """``(scope, token, n)`` for texts that are a scope each, with the mapping's tokens beside them; no shuffle, also on streams."""
    left = unresolved_tokens(F.col(text), F.coalesce(F.col(tokens), F.array().cast("array<string>")))
    counted = F.transform(F.array_distinct(left), lambda t: F.struct(t.alias("token"), F.size(F.filter(left, lambda x: x == t)).alias("n")))
    return rows.select(*scope, F.explode_outer(counted).alias("u")).filter("u IS NOT NULL").select(*scope, "u.token", "u.n")

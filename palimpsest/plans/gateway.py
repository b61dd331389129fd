"""Request routing: requests in; forwarded bodies, mappings and audit entries out.

Everything about one request happens within its row, so nothing is shuffled.
Public blocks are forwarded as they are and not scanned; the paths and commands
they mention decide whether they are public.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.expr import keep_if, let
from palimpsest.functions.tiers import BLOCKED, LOCAL_ONLY, REDACTED, tier_name
from palimpsest.operators.redact import match_total, redact_all
from palimpsest.operators.requests import parse_blocks, rebuild_body
from palimpsest.operators.restore import restore, restore_json
from palimpsest.operators.rules import RuleSet, classify_block
from palimpsest.operators.traffic import detect_agent, resolve_provider
from palimpsest.session import Workspace

REQUEST_SCHEMA = (
    "request_id string, ts timestamp, agent_header string, user_agent string, path string, body string"
)
DENIED = "[access denied: blocked content]"
LOCAL_FAILED = "[local-only content could not be processed]"
LOCAL_MISSING = "[local-only content withheld: no local model]"

Summarizer = Callable[[pd.Series], pd.Series]


def _summaries(texts: Column, summarize: Summarizer) -> Column:
    """Run a summarizer of single texts over the elements of an array column.

    NULL elements are not passed on; a NULL summary means that it failed.
    """

    def per_batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            flat = batch.explode()
            wanted = flat[flat.notna()]
            done = pd.Series(None, index=range(len(flat)), dtype=object)
            positions = flat.notna().to_numpy().nonzero()[0]
            if len(wanted):
                done.iloc[positions] = summarize(wanted.reset_index(drop=True)).to_numpy()
            sizes = [0 if x is None else len(x) for x in batch]
            out, at = [], 0
            for size in sizes:
                out.append([None if pd.isna(v) else v for v in done.iloc[at:at + size]])
                at += max(size, 1)  # an empty array is one NULL row once exploded
            yield pd.Series(out, index=batch.index, dtype=object)

    # A model need not answer the same twice: no expression over the answers may ask again.
    return F.pandas_udf(per_batch, "array<string>").asNondeterministic()(texts)


def process_requests(
    requests: DataFrame,
    rule_set: RuleSet,
    summarize: Summarizer | None = None,
    prefix: str = "Local summary",
    space: Workspace | None = None,
) -> DataFrame:
    """Classify and transform requests ``(request_id, ts, agent_header, user_agent, path, body)``.

    Requests to an unknown provider are left out, see :func:`rejected`.  One row per
    request: ``request_id, ts, agent, provider, new_body, blocked, tokens, values``
    and ``blocks``, an array with tier, source, reason, matches and new content.

    With a summarizer, or a ``space`` for it, the result is written as a table first:
    bodies, mappings and audit entries are then read from the same answers, and no
    block is asked about, classified or redacted once more for each of them.  The table
    holds values in clear; it goes with the space, or with the session if none is
    given.  A stream has a single sink: write the whole result there, and derive the
    outputs from that.
    """
    patterns = rule_set.enabled_patterns()
    known = requests.filter(resolve_provider(F.col("path")).isNotNull()).select(
        "request_id",
        "ts",
        detect_agent(F.col("agent_header"), F.col("user_agent")).alias("agent"),
        resolve_provider(F.col("path")).alias("provider"),
        "body",
        parse_blocks(F.col("body")).alias("parsed"),
    )

    def with_verdict(block: Column) -> Column:
        verdict = classify_block(
            block["content"], block["file_path"], block["command"], block["is_tool_result"], rule_set, F.col("agent")
        )
        return let(
            F.when(block["is_object"], verdict),
            lambda v: F.struct(
                block["is_object"].alias("is_object"),
                block["role"].alias("role"),
                block["content"].alias("content"),
                block["file_path"].alias("file_path"),
                block["command"].alias("command"),
                v["tier"].alias("tier"),
                v["source"].alias("source"),
                v["reason"].alias("reason"),
            ),
        )

    judged = known.withColumn("judged", F.transform("parsed", with_verdict)).drop("parsed")
    local_texts = F.transform("judged", lambda b: F.when(b["tier"] == LOCAL_ONLY, b["content"]))
    judged = judged.withColumn(
        "summaries",
        _summaries(local_texts, summarize)
        if summarize
        else F.transform("judged", lambda _: F.lit(None).cast("string")),
    )

    # A summary gets its tokens from the request's own scope: a scope of its own would
    # hand out the same token names for other values.
    texts = F.zip_with("judged", "summaries", lambda b, s: F.when(b["tier"] == LOCAL_ONLY, s).otherwise(b["content"]))
    active = F.zip_with(
        "judged",
        "summaries",
        lambda b, s: F.coalesce(
            (b["tier"] == REDACTED) | ((b["tier"] == LOCAL_ONLY) & s.isNotNull()), F.lit(False)
        ),
    )
    scoped = judged.withColumn("scope", redact_all(texts, active, patterns))

    missing = LOCAL_FAILED if summarize else LOCAL_MISSING

    def new_content(b: Column, i: Column) -> Column:
        text = F.get(F.col("scope.parts"), i)["text"]
        return (
            F.when(b["tier"] == BLOCKED, F.lit(DENIED))
            .when(
                b["tier"] == LOCAL_ONLY,
                F.when(F.get("summaries", i).isNotNull(), F.concat(F.lit(f"[{prefix}: "), text, F.lit("]")))
                .otherwise(F.lit(missing)),
            )
            .when(b["tier"] == REDACTED, text)
        )

    def outcome(b: Column, i: Column) -> Column:
        return F.struct(
            i.alias("message"),
            b["role"].alias("role"),
            b["file_path"].alias("file_path"),
            b["tier"].alias("tier"),
            b["source"].alias("source"),
            b["reason"].alias("reason"),
            F.get(F.col("scope.parts"), i)["matches"].alias("matches"),
            F.get("summaries", i).isNotNull().alias("summarized"),
            new_content(b, i).alias("new_content"),
        )

    finished = scoped.select(
        "request_id",
        "ts",
        "agent",
        "provider",
        "body",
        F.col("scope.tokens").alias("tokens"),
        F.col("scope.values").alias("values"),
        F.transform("judged", outcome).alias("all_blocks"),
    )
    contents = F.transform("all_blocks", lambda b: b["new_content"])
    processed = finished.select(
        "request_id",
        "ts",
        "agent",
        "provider",
        rebuild_body(F.col("body"), contents).alias("new_body"),
        F.coalesce(F.array_max(F.transform("all_blocks", lambda b: b["tier"])) == BLOCKED, F.lit(False)).alias("blocked"),
        "tokens",
        "values",
        F.filter("all_blocks", lambda b: b["tier"].isNotNull()).alias("blocks"),
    )
    if requests.isStreaming or not (summarize or space):
        return processed
    return (space or Workspace(requests.sparkSession)).written(processed)


def rejected(requests: DataFrame) -> DataFrame:
    """Requests whose path belongs to no known provider."""
    return requests.filter(resolve_provider(F.col("path")).isNull())


def mappings(processed: DataFrame) -> DataFrame:
    """One row per request that has tokens, for restoring its response."""
    return keep_if(processed.select("request_id", "tokens", "values"), F.size("tokens") > 0)


def block_rows(processed: DataFrame) -> DataFrame:
    """One row per content block."""
    request = ["request_id", "ts", "agent", "provider"]
    exploded = processed.select(*request, F.posexplode_outer("blocks").alias("idx", "b"))
    return exploded.filter("idx IS NOT NULL").select(*request, "idx", "b.*")


def audit_entries(processed: DataFrame) -> DataFrame:
    """One audit entry per content block."""
    tier, summarized = F.col("tier"), F.col("summarized")
    withheld = (tier == LOCAL_ONLY) & ~summarized
    unavailable = withheld & (F.col("new_content") == LOCAL_MISSING)
    by_name = F.map_from_entries(F.array_sort("matches"))
    return block_rows(processed).select(
        F.concat_ws("-", "request_id", F.col("idx").cast("string")).alias("id"),
        "ts",
        "agent",
        "provider",
        F.lit("read").alias("action"),
        F.col("file_path").alias("target"),
        F.when(unavailable, F.lit("blocked")).otherwise(tier_name(tier)).alias("tier"),
        F.when(tier == REDACTED, F.to_json(by_name)).alias("redactions"),
        F.lit(False).alias("approved"),
        F.when(tier == BLOCKED, F.concat(F.lit("blocked by rule: "), F.col("source")))
        .when(unavailable, F.lit("local model unavailable"))
        .when(withheld, F.lit("local model failed"))
        .when(tier == LOCAL_ONLY, F.lit("summarized by local model"))
        .alias("notes"),
    )


def restore_responses(responses: DataFrame, mapping: DataFrame, restorer=restore) -> DataFrame:
    """Restore responses ``(request_id, body)``, each with its own request's mapping."""
    joined = responses.join(mapping.select("request_id", "tokens", "values"), "request_id", "left")
    body = F.when(
        F.col("tokens").isNotNull(), restore_json(F.col("body"), F.col("tokens"), F.col("values"), restorer)
    ).otherwise(F.col("body"))
    return joined.select(*[body.alias("body") if c == "body" else F.col(c) for c in responses.columns])


def total_matches(processed: DataFrame) -> DataFrame:
    """Matches per request over all its blocks."""
    return processed.select(
        "request_id", F.aggregate("blocks", F.lit(0), lambda n, b: n + match_total(b["matches"])).alias("matches")
    )



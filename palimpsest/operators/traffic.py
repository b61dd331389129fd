"""Who sent a request, and where it is bound for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# User-agent substrings (lower case) in order of precedence, and the
# known provider path prefixes.
AGENT_SIGNATURES = (
    ("claude-code", "claude-code"),
    ("claudecode", "claude-code"),
    ("anthropic-cli", "claude-code"),
    ("codex", "codex"),
    ("openai-codex", "codex"),
    ("opencode", "opencode"),
    ("hermes", "hermes"),
    ("cursor", "cursor"),
    ("aider", "aider"),
    ("cline", "cline"),
    ("continue-dev", "continue"),
    ("gh copilot", "github-copilot"),
    ("github-copilot", "github-copilot"),
    ("grok-cli", "grok-cli"),
    ("xai-cli", "grok-cli"),
)
PROVIDERS = {
    "anthropic": "api.anthropic.com",
    "openai": "api.openai.com",
    "xai": "api.x.ai",
    "mistral": "api.mistral.ai",
}
# End of fixed values.


def detect_agent(header: Column, user_agent: Column, length: int = 40) -> Column:
    """The explicit header, else a known client, else the user agent's first ``length`` characters.

    Unknown clients that differ only after these are one agent; 40 is the reference's value.
    """
    lower = F.lower(user_agent)
    known = F.when(F.coalesce(user_agent, F.lit("")) == "", F.lit("unknown"))
    for part, name in AGENT_SIGNATURES:
        known = known.when(F.contains(lower, F.lit(part)), F.lit(name))
    named = known.otherwise(F.concat(F.lit("ua:"), F.substring(user_agent, 1, length)))
    return F.coalesce(F.nullif(header, F.lit("")), named)


def resolve_provider(path: Column) -> Column:
    """The provider a request path belongs to, NULL if to none.

    Whole path segments count: ``/openaix`` is not ``/openai``.
    """
    head = F.split_part(path, F.lit("/"), F.lit(2))
    return F.when(F.startswith(path, F.lit("/")) & head.isin(*PROVIDERS), head)


def upstream_host(provider: Column) -> Column:
    """The host of a provider."""
    result = F.lit(None).cast("string")
    for name, host in PROVIDERS.items():
        result = F.when(provider == name, F.lit(host)).otherwise(result)
    return result


def upstream_path(path: Column, query: Column) -> Column:
    """The path without its provider segment, with the query string kept."""
    rest = F.substr(path, F.length(resolve_provider(path)) + 2)
    return F.when(F.coalesce(query, F.lit("")) != "", F.concat(rest, F.lit("?"), query)).otherwise(rest)


#: Registered keys that are handed to every task; more are exchanged by their hash.
BROADCAST_KEYS = 1_000_000


def key_hash(key: Column) -> Column:
    """The fingerprint under which a key is registered; the key itself is stored nowhere."""
    return F.sha2(key.cast("binary"), 256)


def detect_agent_by_key(
    requests: DataFrame,
    keys: DataFrame,
    header: str = "header",
    key: str = "api_key",
    user_agent: str = "user_agent",
    most: int = BROADCAST_KEYS,
) -> DataFrame:
    """``requests`` with ``agent``: the header, else the owner of the key, else what the user agent says.

    ``keys`` is ``(key_hash, agent_name, registered_at)``; of several names for a key the latest counts, then
    the first by name.  Only requests without a header are looked up.  A table of at most ``most`` keys
    goes to every task (64 characters and a name each); a larger one meets the distinct fingerprints in
    question, so a key that many requests have is one row of that join.
    """
    named = F.coalesce(F.col(header), F.lit("")) != ""
    asked = requests.withColumn("_hash", F.when(~named & (F.coalesce(F.col(key), F.lit("")) != ""), key_hash(F.col(key))))
    latest = keys.filter("key_hash IS NOT NULL").groupBy("key_hash").agg(F.max("registered_at").alias("at"))
    same = (F.col("k.key_hash") == F.col("l.key_hash")) & F.col("k.registered_at").eqNullSafe(F.col("l.at"))
    owners = (
        keys.alias("k").join(latest.alias("l"), same).groupBy("k.key_hash").agg(F.min("k.agent_name").alias("_owner"))
        .select(F.col("key_hash").alias("_known"), "_owner")
    )
    if owners.limit(most + 1).count() <= most:
        found = asked.join(F.broadcast(owners), F.col("_hash") == F.col("_known"), "left")
    else:
        few = asked.select(F.col("_hash").alias("_asked")).filter("_asked IS NOT NULL").distinct()
        met = few.join(owners, F.col("_asked") == F.col("_known")).select("_known", "_owner")
        found = asked.join(met, F.col("_hash") == F.col("_known"), "left")
    agent = F.when(named, F.col(header)).otherwise(F.coalesce("_owner", detect_agent(F.lit(None).cast("string"), F.col(user_agent))))
    return found.select(*requests.columns, agent.alias("agent"))

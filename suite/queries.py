"""The registered queries: every operator over whole tables."""

from __future__ import annotations

import datetime as dt
import functools
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.patterns import (
    all_patterns,
    custom_pattern,
    default_patterns,
    patterns_for_toggles,
    patterns_named,
)
from palimpsest.functions.paths import extract_paths
from palimpsest.functions.tiers import tier_name
from palimpsest.operators import audit as audit_ops
from palimpsest.operators import detect, report, risk, traffic
from palimpsest.operators.encoded import redact_encoded as redact_encoded_forms
from palimpsest.operators.redact import mask, match_total, redact
from palimpsest.operators.requests import parse_blocks
from palimpsest.operators.rule_index import classify_many
from palimpsest.operators.restore import restore, restore_event_line, restore_exact, restore_fuzzy, unresolved_tokens
from palimpsest.operators.rules import (
    Config,
    classification_report,
    classify_command,
    classify_path,
    content_tier,
)
from palimpsest.operators.scopes import redact_scopes
from palimpsest.operators.stored import restore_stored
from palimpsest.plans import gateway
from palimpsest.plans.corpus import redact_corpus, redacted_texts
from palimpsest.plans.presets import load_rules
from palimpsest.session import Workspace, settings, working_folder, written
from palimpsest.sources.audit_store import AuditStore, split_rotation
from palimpsest.sources.requests import malformed_count, read_requests
from palimpsest.sources.text import read_texts, spread, write_text_files
from palimpsest.streaming import chunks as chunk_ops
from palimpsest.streaming import responses as response_ops
from palimpsest.streaming import scopes as scope_ops
from palimpsest.streaming import streams
from suite import derived

Query = Callable[[SparkSession, str], DataFrame]

HOME = "/home/user"
STRUCTURE = ("syslog_hostname", "passwd_username")
TOGGLES = {"ipv4": False, "phone": False, "ipv4_private": True, "high_entropy_secret": True}
ROTATE_SINCE = dt.datetime(2024, 1, 10)
ROTATE_UNTIL = dt.datetime(2024, 1, 20, 12)
AUDIT_SINCE = dt.datetime(2024, 1, 20)
CHUNK_SIZE = 23
#: Rows of a table without texts that a task makes texts of, at most.
ROWS_A_TASK = 20_000

# What a user may add: a layer of their own, and sections for two agents.
USER_CONFIG = Config(
    block=("/srv/**/en/**",),
    redact=("~/.ssh/id_en", "/home/user/code/**", "~/projects/**"),
    agents={
        "codex": Config(block=("~/projects/**", "/var/log"), local_only=("/home/*/code/*.go",)),
        "claude-code": Config(redact=("~/.ssh/id_*",)),
    },
)
PROJECT_CONFIG = Config(local_only=("/opt/**",), commands=(("echo *", "redact"), ("ls *", "allow")))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(_table(spark, sf_dir, name), ROWS_A_TASK if name == "events" else None)


def _columns(columns: dict[str, str]) -> list[str]:
    return [f"({expression}) AS {name}" for name, expression in columns.items()]


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "events").selectExpr("event_id", f"({derived.EVENT_LOG}) AS text")


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(*_columns(derived.AUDIT_COLUMNS))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"({derived.TURN_TEXT}) AS text")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON request per conversation turn: a plain message, a message of content
    parts from a tool call, and a tool result."""
    first = F.to_json(F.struct(F.col("role"), F.expr(derived.MESSAGE_0).alias("content")))
    parts = F.concat(
        F.lit("["),
        F.to_json(F.struct(F.lit("text").alias("type"), F.expr(derived.MESSAGE_1_TEXT).alias("text"))),
        F.lit(","),
        F.to_json(F.struct(F.expr(derived.MESSAGE_1_NESTED).alias("content"))),
        F.lit("]"),
    )
    second = F.concat(F.lit('{"role":"assistant","tool_calls":[],"content":'), parts, F.lit("}"))
    third = F.to_json(
        F.struct(F.lit("tool").alias("role"), F.lit("t1").alias("tool_call_id"), F.expr(derived.MESSAGE_2).alias("content"))
    )
    body = F.concat(
        F.lit('{"model":"m","messages":['), first, F.lit(","), second, F.lit(","), third, F.lit('],"stream":true}')
    )
    return _texts(spark, sf_dir, "conversations").select(
        F.expr(derived.REQUEST_ID).alias("request_id"),
        F.lit(dt.datetime(2024, 1, 1)).alias("ts"),
        F.lit("").alias("agent_header"),
        F.lit("aider 0.8.0").alias("user_agent"),
        F.expr(derived.REQUEST_PATH).alias("path"),
        body.alias("body"),
    )


def _processed(spark: SparkSession, sf_dir: str, summarize=None) -> DataFrame:
    return gateway.process_requests(_requests(spark, sf_dir), load_rules("server", home=HOME), summarize)


def _redacted_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_corpus(
        _texts(spark, sf_dir, "documents"), "text", ["doc_id", "lang", "source"], load_rules("training-data")
    )


def _redacted_logs(spark: SparkSession, sf_dir: str, patterns=None) -> DataFrame:
    return redact_corpus(_logs(spark, sf_dir), "text", ["event_id"], all_patterns() if patterns is None else patterns)


# --- detection and tokenization ---


def detect_counts_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.count_by_pattern(_texts(spark, sf_dir, "documents"), "text", all_patterns())


def detect_counts_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.count_by_pattern(_logs(spark, sf_dir), "text", all_patterns())


def detect_hits_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.hits(_texts(spark, sf_dir, "documents"), "text", ["doc_id"], all_patterns())


def detect_hits_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.hits(_texts(spark, sf_dir, "pages"), "html", ["page_id"], all_patterns())


def mask_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "documents").select("doc_id", mask("text", all_patterns()).alias("masked"))


def mask_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logs(spark, sf_dir).select("event_id", mask("text", all_patterns()).alias("masked"))


def redact_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_texts(_redacted_docs(spark, sf_dir), ["doc_id"])


def redact_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.mapping_rows(_redacted_docs(spark, sf_dir), ["doc_id"])


def redact_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = redact_corpus(_texts(spark, sf_dir, "pages"), "html", ["page_id"], default_patterns())
    return redacted_texts(pages, ["page_id"])


def redact_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_texts(_redacted_logs(spark, sf_dir), ["event_id"])


def redact_logs_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.mapping_rows(_redacted_logs(spark, sf_dir), ["event_id"])


def redact_logs_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_texts(_redacted_logs(spark, sf_dir, load_rules("desktop")), ["event_id"])


def redact_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_texts(_redacted_logs(spark, sf_dir, patterns_for_toggles(TOGGLES)), ["event_id"])


def structure_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_texts(_redacted_logs(spark, sf_dir, patterns_named(STRUCTURE)), ["event_id"])


def redact_custom_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = [custom_pattern("customer_number", r"\bCustomer#(\d+)\b", "CUST", group=1)]
    customers = _table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" / ", "c_name", "c_mktsegment", "c_name").alias("text"))
    return redacted_texts(redact_corpus(customers, "text", ["c_custkey"], patterns), ["c_custkey"])


#: Patterns that a user may add: classes by name, groups with and without a name, flags, anchors, repeats.
CUSTOM = (
    ("request_ref", r"\b[[:digit:]]{4}[[:space:]][[:digit:]]{4}[[:space:]][[:digit:]]{4}\b", "REF", 0),
    ("app_number", r"app\[(?P<number>[0-9]+)\]", "APP", 1),
    ("event_kind", r"(?i)\]: (VIEW|click|Signup) from", "KIND", 1),
    ("host_number", r"\bhost-(?P<n>\d{1,2})\b", "HOSTNO", 1),
    ("last_line", r"(?m)^[a-z]+(?:[:=]|)[^\n]{0,12}\n\z", "LAST", 0),
    ("colour_run", r"\b(?:[[:xdigit:]]{2}:){5}[[:xdigit:]]{2}\b", "HW", 0),
    ("user_word", r"\b[Uu]ser\d+\b", "PERSON", 0),
    ("bracketed", r"\([^()\n]{3}\)", "AREA", 0),
    ("upper_word", r"\b[[:upper:]]{4,}\b", "UPPER", 0),
    ("port", r":(\d{4})/", "PORT", 1),
)


def redact_custom_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = [custom_pattern(*p) for p in CUSTOM]
    return redacted_texts(_redacted_logs(spark, sf_dir, patterns), ["event_id"])


def redact_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in encoded forms: what is handed on, how many were encoded, and whether restoring gives the text back."""
    text = derived.encoded_text(lambda x: f"base64({x})")
    events = _texts(spark, sf_dir, "events").selectExpr("event_id", f"({text}) AS text")
    done = redact_encoded_forms(events, "text", patterns_named(("email", "ipv4")), "r")
    return done.select(
        "event_id", F.col("r.text").alias("redacted"), F.col("r.encoded").alias("encoded"), F.size("r.tokens").alias("values"),
        report.round_trips(F.col("text"), F.col("r")).alias("same"),
    )


def roundtrip_token_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with token-shaped texts, redacted twice, and restored step by step."""
    logs = _texts(spark, sf_dir, "events").selectExpr("event_id", f"({derived.SHAPED_LOG}) AS text")
    once = logs.select("event_id", redact("text", all_patterns()[::2]).alias("a"))
    twice = once.select("event_id", "a", redact("a.text", all_patterns()).alias("b"))
    back = twice.select("event_id", "a", "b", restore(F.col("b.text"), F.col("b.tokens"), F.col("b.values")).alias("once"))
    clash = F.filter("b.tokens", lambda t: F.contains(F.col("a.text"), t))
    return back.select(
        "event_id", "once", restore(F.col("once"), F.col("a.tokens"), F.col("a.values")).alias("text"), F.size(clash).alias("clashes")
    )


def redact_conversation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = redact_scopes(_turns(spark, sf_dir), "conv_id", "turn", "text", patterns_named(("email", "ipv4")))
    return rows.select("conv_id", "turn", "redacted", match_total(F.col("matches")).alias("matches"))


def conversation_scope_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_scopes(_turns(spark, sf_dir), "conv_id", "turn", "text", patterns_named(("email", "ipv4")))[1]


# --- reports ---


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.corpus_summary(_redacted_docs(spark, sf_dir))


def corpus_summary_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.corpus_summary(_redacted_logs(spark, sf_dir))


def summary_by_lang_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc = _redacted_docs(spark, sf_dir).select("lang", "source", match_total(F.col("redacted.matches")).alias("n"))
    return per_doc.groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(
        F.count("*").alias("docs"), F.sum("n").alias("matches"), F.count_if(F.col("n") > 0).alias("docs_with_hits")
    )


def roundtrip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _redacted_docs(spark, sf_dir).select(F.lit("documents").alias("corpus"), "text", "redacted")
    logs = _redacted_logs(spark, sf_dir).select(F.lit("logs").alias("corpus"), "text", "redacted")
    checked = docs.unionByName(logs).select("corpus", report.round_trips(F.col("text"), F.col("redacted")).alias("same"))
    return checked.groupBy("corpus").agg(F.count("*").alias("texts"), F.count_if("same").alias("identical"))


def dryrun_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.changed_lines(_redacted_docs(spark, sf_dir), ["doc_id"], "text")


def dryrun_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.changed_lines(_redacted_logs(spark, sf_dir), ["event_id"], "text", all_lines=True)


def toxic_quality_vs_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    per_doc = _redacted_docs(spark, sf_dir).select("doc_id", match_total(F.col("redacted.matches")).alias("n"))
    return per_doc.join(labels, "doc_id").groupBy("quality", "toxic").agg(
        F.count("*").alias("docs"), F.count_if(F.col("n") > 0).alias("docs_with_hits"), F.sum("n").alias("matches")
    )


# --- rules ---


def _verdict(paths: DataFrame, keep: list[str], verdict: Column) -> DataFrame:
    return paths.withColumn("v", verdict).select(
        *keep, F.col("v.tier").alias("tier"), tier_name(F.col("v.tier")).alias("tier_name"), F.col("v.source").alias("source")
    )


def _doc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"({derived.DOC_PATH}) AS path", f"({derived.DOC_AGENT}) AS agent"
    )


def classify_url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = load_rules("paranoid", project=Config(redact=("/en/**",), local_only=("/fr/*[02468]",), block=("/{de,es}/**",)), home=HOME)
    paths = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))
    return _verdict(paths, ["page_id", "path"], classify_path(F.col("path"), rules))


def _classify_preset(preset: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = load_rules(preset, home=HOME)
        return _verdict(_doc_paths(spark, sf_dir), ["doc_id", "path"], classify_path(F.col("path"), rules))

    return query


def classify_path_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = load_rules("server", user=USER_CONFIG, project=PROJECT_CONFIG, home=HOME)
    return _verdict(_doc_paths(spark, sf_dir), ["doc_id", "path"], classify_path(F.col("path"), rules))


def classify_agent_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = load_rules("server", user=USER_CONFIG, project=PROJECT_CONFIG, home=HOME)
    verdict = classify_path(F.col("path"), rules, F.col("agent"))
    return _verdict(_doc_paths(spark, sf_dir), ["doc_id", "agent", "path"], verdict)


def classify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification_report(_doc_paths(spark, sf_dir), "path", load_rules("server", home=HOME))


def classify_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table with a row for every event, against a path for every event."""
    events = _table(spark, sf_dir, "events")
    rules = events.selectExpr(
        "'path' AS kind", "'' AS agent", f"{derived.MANY_LAYER} AS layer", "event_id AS ord", f"{derived.MANY_PATTERN} AS pattern",
        f"{derived.MANY_TIER} AS tier", "'rule ' || CAST(event_id AS STRING) AS source",
    )
    paths = events.selectExpr(f"{derived.MANY_PATH} AS path")
    return classify_many(paths, "path", rules, HOME)


def classify_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = load_rules("server", project=PROJECT_CONFIG, home=HOME)
    commands = _table(spark, sf_dir, "events").selectExpr("event_id", f"({derived.EVENT_COMMAND}) AS command")
    return _verdict(commands, ["event_id", "command"], classify_command(F.col("command"), rules))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"({derived.MESSAGE_0}) AS content")


def extract_text_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", "turn", F.posexplode(extract_paths(F.col("content"))).alias("pos", "path"))


def escalate_block_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = load_rules("server", home=HOME)
    return _messages(spark, sf_dir).select("conv_id", "turn", content_tier(F.col("content"), rules).alias("tier"))


def bypass_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of any length with encoded values, by kind of event; what is unusual is learned from all of them."""
    text = derived.encoded_text(lambda x: f"base64({x})")
    events = _texts(spark, sf_dir, "events").selectExpr("event_id", "event_type AS source", f"({text}) || {derived.PADDING} AS text")
    done = redact_encoded_forms(events, "text", patterns_named(("email", "ipv4")), "r")
    rows = written(
        done.select(
            "event_id", "source", risk.density(F.col("text"), F.col("r.matches")).alias("density"),
            match_total(F.col("r.matches")).alias("matches"), F.col("r.encoded").alias("encoded"),
        )
    )
    return risk.bypass_risk(rows, risk.usual_density(rows, quantile=0.9), least=2)


# --- requests ---


def detect_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = _table(spark, sf_dir, "events").selectExpr(
        "event_id", f"({derived.EVENT_HEADER}) AS header", f"({derived.EVENT_USER_AGENT}) AS user_agent"
    )
    return clients.groupBy(traffic.detect_agent(F.col("header"), F.col("user_agent")).alias("agent")).agg(F.count("*").alias("n"))


def detect_agent_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the keys of customers, against all registered keys: handed to every task, and exchanged by hash."""
    events = _table(spark, sf_dir, "events").selectExpr(
        "event_id", f"({derived.EVENT_HEADER}) AS header", f"({derived.EVENT_USER_AGENT}) AS user_agent", f"({derived.EVENT_KEY}) AS api_key"
    )
    customers = _table(spark, sf_dir, "customer").selectExpr(*_columns(derived.KEY_COLUMNS))
    keys = customers.select(traffic.key_hash(F.col("api_key")).alias("key_hash"), "agent_name", "registered_at")
    small = traffic.detect_agent_by_key(events, keys).withColumn("way", F.lit("small"))
    large = traffic.detect_agent_by_key(events, keys, most=0).withColumn("way", F.lit("large"))
    return small.unionByName(large).select("way", "event_id", "agent")


def resolve_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _table(spark, sf_dir, "events").selectExpr(
        "event_id", f"({derived.EVENT_PATH}) AS path", f"({derived.EVENT_QUERY}) AS query"
    )
    provider = traffic.resolve_provider(F.col("path"))
    return calls.select(
        "event_id",
        provider.alias("provider"),
        traffic.upstream_host(provider).alias("host"),
        traffic.upstream_path(F.col("path"), F.col("query")).alias("upstream_path"),
    )


def parse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _requests(spark, sf_dir).select(
        "request_id", F.posexplode_outer(parse_blocks(F.col("body"))).alias("idx", "b")
    ).filter("idx IS NOT NULL")
    return blocks.select("request_id", "idx", "b.role", "b.content", "b.file_path", "b.command", "b.is_tool_result", "b.is_system")


def route_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gateway.block_rows(_processed(spark, sf_dir)).select(
        "request_id", "agent", "provider", "idx", "tier", "source", "reason", "new_content"
    )


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processed(spark, sf_dir).select(
        "request_id",
        "blocked",
        F.get_json_object("new_body", "$.messages[0].content").alias("content_0"),
        F.get_json_object("new_body", "$.messages[1].content").alias("content_1"),
        F.get_json_object("new_body", "$.messages[2].content").alias("content_2"),
        F.get_json_object("new_body", "$.messages[2].tool_call_id").alias("call_id"),
        F.get_json_object("new_body", "$.model").alias("model"),
    )


def route_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.arrays_zip(F.col("tokens").alias("token"), F.col("values").alias("value"))
    return gateway.mappings(_processed(spark, sf_dir)).select("request_id", F.inline(pairs))


def route_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    def last_words(texts: pd.Series) -> pd.Series:
        """Stands in for a local model: keeps the end of a text, fails on mentions of mysql."""
        return texts.map(lambda t: None if "mysql" in t else t[-60:])

    return gateway.block_rows(_processed(spark, sf_dir, last_words)).select("request_id", "idx", "tier", "new_content")


def route_summaries_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that never answers twice the same: what a summary's token stands for is what
    the body, the mapping and the audit entries all come from."""

    def answer(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f"{t[-60:]} seen by {uuid.uuid4().hex}@example.com")

    processed = _processed(spark, sf_dir, answer)
    mapping = gateway.mappings(processed)
    blocks = gateway.block_rows(processed).filter("summarized").select("request_id", "idx", "new_content")
    restored = blocks.join(mapping, "request_id").select(
        "request_id", "idx", restore(F.col("new_content"), F.col("tokens"), F.col("values")).alias("text")
    )
    again = gateway.mappings(processed).select("request_id", F.col("values").alias("known"))
    audited = gateway.audit_entries(processed).select("id", "notes")
    seen = F.regexp_extract("text", r"seen by ([0-9a-f]{32}@example\.com)", 1)
    own = restored.join(again, "request_id").withColumn("id", F.concat_ws("-", "request_id", F.col("idx").cast("string")))
    return own.join(audited, "id").select("request_id", "idx", F.array_contains("known", seen).alias("own"), "notes")


def route_landed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from JSON lines: whole ones, ones whose body is cut, and lines that are cut."""
    folder = working_folder(spark)
    requests = _requests(spark, sf_dir)
    body = F.when(F.endswith("request_id", F.lit("1")), F.substr("body", F.lit(1), F.length("body") - 2)).otherwise(F.col("body"))
    headers = F.create_map(F.lit("user-agent"), F.col("user_agent"), F.lit("X-AGENT"), F.lit("team"))
    line = F.to_json(F.struct("request_id", "ts", "path", headers.alias("headers"), body.alias("body")))
    cut = F.when(F.endswith("request_id", F.lit("2")), F.substr(line, F.lit(1), F.length(line) - 5)).otherwise(line)
    requests.select(cut.alias("value")).write.text(f"{folder}/in")
    landed = read_requests(spark, f"{folder}/in")
    processed = gateway.process_requests(landed, load_rules("server", home=HOME))
    same = landed.filter("malformed IS NULL").select("request_id", "body").join(
        processed.select("request_id", "agent", "new_body", F.size("blocks").alias("n")), "request_id"
    )
    routed = same.select("request_id", "agent", "n", (F.col("body") == F.col("new_body")).alias("as_it_was"))
    kept = malformed_count(landed).select(
        F.lit("malformed").alias("request_id"), F.lit("").alias("agent"), F.col("malformed").cast("int").alias("n"), F.lit(True).alias("as_it_was")
    )
    passed = routed.withColumn("as_it_was", F.when(F.col("n") == 0, F.col("as_it_was")))
    return passed.unionByName(kept)


def text_files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn to a file of its own and back, byte for byte."""
    folder = working_folder(spark)
    turns = _turns(spark, sf_dir).select(F.concat_ws("/", F.col("conv_id").cast("string"), F.concat("turn", F.lit(".txt"))).alias("name"), "text")
    write_text_files(turns, [sf_dir], f"{folder}/texts", "name")
    back = read_texts(spark, f"{folder}/texts/*")
    return back.select(F.regexp_extract("path", r"(\d+/\d+)\.txt$", 1).alias("name"), "text")


def gateway_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gateway.audit_entries(_processed(spark, sf_dir)).select(
        "id", "agent", "provider", "action", "target", "tier", "redactions", "approved", "notes"
    )


def restore_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's answer quotes its redacted messages; restoring gives them back."""
    processed = _processed(spark, sf_dir)
    quoted = F.array_join(F.transform(F.filter("blocks", lambda b: b["tier"] == 1), lambda b: b["new_content"]), " | ")
    answers = processed.select(
        "request_id", F.to_json(F.struct(F.struct(quoted.alias("text")).alias("message"), F.lit("[TG:IP:1]").alias("a[TG:IP:1]"))).alias("body")
    )
    restored = gateway.restore_responses(answers, gateway.mappings(processed))
    return restored.select("request_id", F.get_json_object("body", "$.message.text").alias("text"))


# --- restoring ---


def _reformatted(tokens: Column) -> Column:
    """Tokens the way a model may write them: bare, in quotes, in backticks, with underscores."""

    def spelled(token: Column, i: Column) -> Column:
        bare = F.substr(token, F.lit(2), F.length(token) - 2)
        quoted = F.when(i % 4 == 0, F.concat(F.lit('"'), bare, F.lit('"')))
        return (
            quoted.when(i % 4 == 1, F.concat(F.lit("`"), bare, F.lit("`")))
            .when(i % 4 == 2, F.translate(bare, ":", "_"))
            .otherwise(bare)
        )

    return F.array_join(F.transform(tokens, spelled), " , ")


def _restored(restorer) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = F.col("redacted")
        return _redacted_logs(spark, sf_dir).select("event_id", restorer(r["text"], r["tokens"], r["values"]).alias("text"))

    return query


def restore_fuzzy_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("redacted")
    answers = _redacted_logs(spark, sf_dir).select("event_id", "redacted", _reformatted(r["tokens"]).alias("answer"))
    return answers.select("event_id", restore_fuzzy(F.col("answer"), r["tokens"], r["values"]).alias("text"))


def restore_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("redacted")
    kind = F.when(F.col("event_id") % 2 == 0, F.lit("data: ")).otherwise(F.lit("event: "))
    lines = _redacted_logs(spark, sf_dir).select("event_id", "redacted", F.concat(kind, F.array_join(r["tokens"], " ")).alias("line"))
    return lines.select("event_id", restore_event_line(F.col("line"), r["tokens"], r["values"]).alias("line"))


def _stored_corpus(corpus: DataFrame, key: str) -> DataFrame:
    space = Workspace(corpus.sparkSession)
    corpus = space.written(corpus)
    texts = space.written(corpus.select(key, F.col("redacted.text").alias("text")))
    return restore_stored(texts, [key], "text", space.written(report.mapping_rows(corpus, [key])), space=space)


def restore_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents from what is stored of them: redacted texts and the long-form mapping."""
    return _stored_corpus(_redacted_docs(spark, sf_dir), "doc_id")


def restore_corpus_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for logs, whose values have tokens in them."""
    return _stored_corpus(_redacted_logs(spark, sf_dir), "event_id")


def restore_conversation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations redacted with all patterns, from stored turns and the scopes' mapping."""
    space = Workspace(spark)
    rows, mapping = redact_scopes(_turns(spark, sf_dir), "conv_id", "turn", "text", all_patterns(), space)
    texts = space.written(rows.select("conv_id", "turn", F.col("redacted").alias("text")))
    return restore_stored(texts, ["conv_id", "turn"], "text", space.written(mapping), ["conv_id"], space)


def unresolved_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens left over if every second mapping entry is lost."""
    r = F.col("redacted")
    known = F.filter(r["tokens"], lambda _, i: i % 2 == 0)
    return _redacted_logs(spark, sf_dir).select("event_id", F.posexplode(unresolved_tokens(r["text"], known)).alias("pos", "token"))


def unresolved_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against a mapping table that has lost every token with an odd number."""
    logs = _redacted_logs(spark, sf_dir)
    texts = logs.select("event_id", F.col("redacted.text").alias("text"))
    mapping = report.mapping_rows(logs, ["event_id"]).filter("token NOT LIKE '%1]'")
    return report.unresolved_rows(texts, ["event_id"], "text", mapping)


# --- audit ---


def audit_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a mapping has lost, as audit entries: each once, whatever is tried again.

    The batch job appends under a name and is tried again; then it comes over the same data without
    one; a stream of the same texts, whose mapping lacks other tokens, appends in two runs.
    """
    folder, store = _stamped_store(spark)
    logs = written(_redacted_logs(spark, sf_dir))
    texts = logs.select("event_id", F.col("redacted.text").alias("text"))
    mapping = report.mapping_rows(logs, ["event_id"]).filter("token NOT LIKE '%1]'")
    left = audit_ops.unresolved_entries(report.unresolved_rows(texts, ["event_id"], "text", mapping), ["event_id"], "agent-1")
    store.append(left, once="job")
    store.append(left, once="job")
    store.append_missing(left)
    known = F.filter("redacted.tokens", lambda t: ~F.endswith(t, F.lit("2]")))
    rows = logs.select(F.lit("stream").alias("job"), "event_id", F.col("redacted.text").alias("text"), known.alias("tokens"))
    for half in (0, 1):
        rows.filter(f"event_id % 2 = {half}").write.mode("append").parquet(f"{folder}/in")
        stream = audit_ops.unresolved_of_rows(streams.stream_table(spark, f"{folder}/in", rows.schema), ["job", "event_id"], "text", "tokens")
        store.append_stream(audit_ops.unresolved_entries(stream, ["job", "event_id"]), f"{folder}/checkpoint").awaitTermination()
    return store.read().select("id", "agent", "action", "target", "notes")


def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_ops.recent(_audit(spark, sf_dir), limit=500).drop("ts")


def audit_by_agent_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_ops.all_entries(_audit(spark, sf_dir), "agent-1", AUDIT_SINCE).select("id", "agent", "tier", "target", "notes")


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_ops.summary(_audit(spark, sf_dir))


def audit_summary_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_ops.summary(_audit(spark, sf_dir), AUDIT_SINCE)


def audit_redaction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_ops.redaction_totals(_audit(spark, sf_dir))


def audit_rotate_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    archived, retained = split_rotation(_audit(spark, sf_dir), ROTATE_SINCE, ROTATE_UNTIL)
    return (
        archived.select(F.lit("archived").alias("part"), "id", "tier")
        .unionByName(retained.select(F.lit("retained").alias("part"), "id", "tier"))
        .groupBy("part", "tier")
        .agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    )


def audit_store_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append to a store, rotate a period out, and read archive and store back."""
    folder = working_folder(spark)
    store = AuditStore(spark, f"{folder}/store")
    store.append(_audit(spark, sf_dir))
    store.rotate(f"{folder}/archive", ROTATE_SINCE, ROTATE_UNTIL)
    archive = spark.read.schema(store.read().drop("date").schema).json(f"{folder}/archive")
    return (
        store.read().select(F.lit("retained").alias("part"), "tier", "redactions")
        .unionByName(archive.select(F.lit("archived").alias("part"), "tier", "redactions"))
        .groupBy("part", "tier")
        .agg(F.count("*").alias("n"), F.count_if(audit_ops.has_redactions(F.col("redactions"))).alias("redacted"))
    )


def _stamped_store(spark: SparkSession) -> tuple[str, AuditStore]:
    folder = working_folder(spark)
    return folder, AuditStore(spark, f"{folder}/store")


def audit_mixed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch, stream and batch again append to one store."""
    folder, store = _stamped_store(spark)
    audit = written(_audit(spark, sf_dir))
    store.append(audit.filter("tier = 'public'"))
    audit.filter("tier = 'redacted'").write.parquet(f"{folder}/in")
    stream = streams.stream_table(spark, f"{folder}/in", audit.schema)
    store.append_stream(stream, f"{folder}/checkpoint").awaitTermination()
    store.append(audit.filter("tier NOT IN ('public', 'redacted')"))
    return store.read().select("id", "agent", "tier", "target")


def audit_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends, compacted before and after a rotation, with entries that come later; beside a tail of the appends."""
    folder, store = _stamped_store(spark)
    audit = written(_audit(spark, sf_dir))
    for tier in ("public", "blocked"):
        store.append(audit.filter(F.col("tier") == tier))
    store.compact()
    store.append(audit.filter("tier = 'local-only'"), once="local")
    store.rotate(f"{folder}/archive", ROTATE_SINCE, ROTATE_UNTIL)
    store.compact()
    store.append(audit.filter("tier = 'local-only'"), once="local")
    store.append(audit.filter("tier = 'redacted'"))
    tail = streams.audit_tail(spark, f"{folder}/store/entries").select("id", "tier")
    streams.run_available(tail, f"{folder}/out", f"{folder}/checkpoint")
    archive = spark.read.schema(store.read().drop("date").schema).json(f"{folder}/archive")
    parts = {"retained": store.read(), "archived": archive, "tail": spark.read.schema("id string, tier string").parquet(f"{folder}/out")}
    return functools.reduce(DataFrame.unionByName, (rows.select(F.lit(p).alias("part"), "id", "tier") for p, rows in parts.items()))


def audit_rotate_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with old stamps that are appended after a rotation stay."""
    folder, store = _stamped_store(spark)
    audit = written(_audit(spark, sf_dir))
    store.append(audit.filter("tier <> 'redacted'"))
    store.rotate(f"{folder}/archive", ROTATE_SINCE, ROTATE_UNTIL)
    store.append(audit.filter("tier = 'redacted'"))
    archive = spark.read.schema(store.read().drop("date").schema).json(f"{folder}/archive")
    kept = store.read().select(F.lit("retained").alias("part"), "id", "tier")
    return kept.unionByName(archive.select(F.lit("archived").alias("part"), "id", "tier"))


def audit_since_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store written under another time zone, filtered by date."""
    _, store = _stamped_store(spark)
    # an instant before the zone changes, whatever type the table has
    audit = written(_audit(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    with settings(spark, {"spark.sql.session.timeZone": "America/Los_Angeles"}):
        store.append(audit)
    return audit_ops.entries(store.read(), since=AUDIT_SINCE).select("id", "agent", "tier", "target")


# --- streams ---


def stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = working_folder(spark)
    documents = _texts(spark, sf_dir, "documents")
    documents.write.parquet(f"{folder}/in")
    docs = streams.stream_table(spark, f"{folder}/in", documents.schema)
    redacted = docs.select("doc_id", redact("text", all_patterns()).alias("redacted"))
    streams.run_available(redacted.select("doc_id", "redacted.text"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("doc_id bigint, text string").parquet(f"{folder}/out")


def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = working_folder(spark)
    requests = _requests(spark, sf_dir)
    requests.write.parquet(f"{folder}/in")
    processed = gateway.process_requests(
        streams.stream_table(spark, f"{folder}/in", requests.schema), load_rules("server", home=HOME)
    )
    entries = gateway.audit_entries(processed).select("id", "tier", "redactions")
    streams.run_available(entries, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("id string, tier string, redactions string").parquet(f"{folder}/out")


def _chunks(redacted: DataFrame) -> DataFrame:
    """Redacted turns as responses that arrive in small pieces."""
    text = F.col("redacted.text")
    last = F.floor((F.length(text) - 1) / CHUNK_SIZE).cast("int")
    return redacted.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("response_id"),
        F.explode(F.sequence(F.lit(0), last)).alias("seq"),
        text.alias("t"),
        last.alias("last"),
    ).select(
        "response_id",
        F.col("seq").cast("bigint").alias("seq"),
        F.substr("t", F.col("seq") * CHUNK_SIZE + 1, F.lit(CHUNK_SIZE)).alias("chunk"),
        (F.col("seq") == F.col("last")).alias("is_last"),
    )


def _redacted_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    redacted = written(redact_corpus(_turns(spark, sf_dir), "text", ["conv_id", "turn"], all_patterns()))
    mapping = redacted.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        "redacted.tokens",
        "redacted.values",
    )
    return redacted, mapping


def _whole(restored: DataFrame) -> DataFrame:
    """The pieces of each response put together again, to compare with its original."""
    order = [c for c in ("seq", "part", "text") if c in restored.columns]
    pieces = restored.groupBy("response_id").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("p"))
    return pieces.select("response_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def stream_chunk_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = working_folder(spark)
    redacted, mapping = _redacted_turns(spark, sf_dir)
    _chunks(redacted).write.parquet(f"{folder}/in")
    stream = streams.stream_table(spark, f"{folder}/in", chunk_ops.CHUNK_SCHEMA)
    restored = chunk_ops.restore_chunks(chunk_ops.realign_stream(stream), mapping, restore)
    streams.run_available(restored, f"{folder}/out", f"{folder}/checkpoint")
    return _whole(spark.read.schema("response_id string, seq bigint, text string").parquet(f"{folder}/out"))


def chunk_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    redacted, mapping = _redacted_turns(spark, sf_dir)
    return _whole(chunk_ops.restore_chunks(chunk_ops.realign(_chunks(redacted)), mapping, restore))


def chunk_restore_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with gaps, and more empty chunks in the middle of a token than are looked back over."""
    redacted, mapping = _redacted_turns(spark, sf_dir)
    chunks = _chunks(redacted).withColumn("seq", F.col("seq") * 1000)
    empty = chunks.filter("seq = 0").select(
        "response_id", F.explode(F.sequence(F.lit(1), F.lit(70)).cast("array<bigint>")).alias("seq"),
        F.lit("").alias("chunk"), F.lit(False).alias("is_last"),
    )
    return _whole(chunk_ops.restore_chunks(chunk_ops.realign(chunks.unionByName(empty)), mapping, restore))


def chunk_restore_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reformatted tokens in chunks of 7 characters, with the default restorer."""
    r = F.col("redacted")
    answers = written(
        _redacted_logs(spark, sf_dir).select(
            F.col("event_id").cast("string").alias("response_id"), "redacted", _reformatted(r["tokens"]).alias("t")
        )
    )
    chunks = answers.select("response_id", "t", F.explode(F.sequence(F.lit(0), F.floor(F.length("t") / 7))).alias("seq")).select(
        "response_id", "seq", F.substr("t", (F.col("seq") * 7 + 1).cast("int"), F.lit(7)).alias("chunk"), F.lit(False).alias("is_last")
    )
    mapping = answers.select(F.col("response_id").alias("request_id"), "redacted.tokens", "redacted.values")
    return _whole(chunk_ops.restore_chunks(chunk_ops.realign(chunks), mapping))


def _streamed_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that arrive in four pieces, with a new run after each second one."""
    folder = working_folder(spark)
    turns = written(_turns(spark, sf_dir))
    for i, piece in enumerate(("turn < 2", "turn BETWEEN 2 AND 3", "turn BETWEEN 4 AND 5", "turn > 5")):
        turns.filter(piece).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if i % 2:
            stream = streams.stream_table(spark, f"{folder}/in", turns.schema, files_per_batch=1)
            rows = scope_ops.redact_scopes_stream(stream, "conv_id", "turn", "text", patterns_named(("email", "ipv4")))
            scope_ops.run_scopes(rows, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def stream_conversation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed_scopes(spark, sf_dir).select("conv_id", "turn", "redacted", match_total(F.col("matches")).alias("matches"))


def stream_scope_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope_ops.stream_mapping(_streamed_scopes(spark, sf_dir), "conv_id")


def _responses(spark: SparkSession, pieces: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Chunks and mappings that arrive piece by piece, with a run after each; the last run comes an hour later."""
    folder = working_folder(spark)
    start = dt.datetime(2024, 1, 1)
    stream = functools.partial(streams.stream_table, spark, files_per_batch=2)
    spark.createDataFrame([], response_ops.CLOCK).write.parquet(f"{folder}/clock")
    for i, (chunks, mappings) in enumerate(pieces):
        at = start + dt.timedelta(seconds=i)
        for name, rows in (("chunks", chunks), ("mappings", mappings)):
            rows.withColumn("at", F.lit(at).cast("timestamp")).write.mode("append").parquet(f"{folder}/{name}")
        restored = response_ops.restore_responses_stream(
            stream(f"{folder}/chunks", response_ops.CHUNKS), stream(f"{folder}/mappings", response_ops.MAPPINGS),
            stream(f"{folder}/clock", response_ops.CLOCK), restorer=restore,
        )
        strike = at + dt.timedelta(hours=1) if i == len(pieces) - 1 else at
        response_ops.run_responses(restored, f"{folder}/out", f"{folder}/checkpoint", f"{folder}/clock", strike)
    return _whole(spark.read.schema(response_ops.RESTORED).parquet(f"{folder}/out"))


def stream_chunk_late_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other mapping comes when half of its response's chunks have passed."""
    redacted, mapping = _redacted_turns(spark, sf_dir)
    chunks = written(_chunks(redacted))
    early = F.pmod(F.xxhash64("request_id"), F.lit(2)) == 0
    return _responses(spark, [(chunks.filter("seq < 5"), mapping.filter(early)), (chunks.filter("seq >= 5"), mapping.filter(~early))])


def stream_chunk_broken_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No response ends: each breaks off within its last token."""
    redacted, mapping = _redacted_turns(spark, sf_dir)
    cut = redacted.withColumn("redacted", F.col("redacted").withField("text", F.expr("substr(redacted.text, 1, length(redacted.text) - 3)")))
    return _responses(spark, [(_chunks(cut).withColumn("is_last", F.lit(False)), mapping)])


def stream_audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = working_folder(spark)
    store = AuditStore(spark, f"{folder}/store")
    store.append(_audit(spark, sf_dir))
    tail = streams.audit_tail(spark, f"{folder}/store/entries", "agent-2").select("id", "tier", "target")
    streams.run_available(tail, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("id string, tier string, target string").parquet(f"{folder}/out")


QUERIES: dict[str, Query] = {
    "detect_counts_by_pattern": detect_counts_by_pattern,
    "detect_counts_logs": detect_counts_logs,
    "detect_hits_long": detect_hits_long,
    "detect_hits_pages": detect_hits_pages,
    "mask_typed": mask_typed,
    "mask_logs": mask_logs,
    "redact_numbered": redact_numbered,
    "redact_mapping": redact_mapping,
    "redact_html": redact_html,
    "redact_logs": redact_logs,
    "redact_logs_mapping": redact_logs_mapping,
    "redact_logs_defaults": redact_logs_defaults,
    "redact_toggles": redact_toggles,
    "structure_patterns": structure_patterns,
    "redact_custom_pattern": redact_custom_pattern,
    "redact_custom_patterns": redact_custom_patterns,
    "redact_encoded": redact_encoded,
    "roundtrip_token_shaped": roundtrip_token_shaped,
    "redact_conversation_scope": redact_conversation_scope,
    "conversation_scope_mapping": conversation_scope_mapping,
    "corpus_summary": corpus_summary,
    "corpus_summary_logs": corpus_summary_logs,
    "summary_by_lang_source": summary_by_lang_source,
    "roundtrip_check": roundtrip_check,
    "dryrun_changed_lines": dryrun_changed_lines,
    "dryrun_all_lines": dryrun_all_lines,
    "toxic_quality_vs_pii": toxic_quality_vs_pii,
    "classify_url_paths": classify_url_paths,
    "classify_desktop": _classify_preset("desktop"),
    "classify_server": _classify_preset("server"),
    "classify_paranoid": _classify_preset("paranoid"),
    "classify_training_data": _classify_preset("training-data"),
    "classify_path_layers": classify_path_layers,
    "classify_agent_override": classify_agent_override,
    "classify_report": classify_report,
    "classify_many_rules": classify_many_rules,
    "classify_commands": classify_commands,
    "extract_paths": extract_text_paths,
    "escalate_block_tier": escalate_block_tier,
    "detect_agent": detect_agent,
    "detect_agent_fingerprint": detect_agent_fingerprint,
    "bypass_risk": bypass_risk,
    "audit_unresolved": audit_unresolved,
    "audit_compacted": audit_compacted,
    "resolve_provider": resolve_provider,
    "parse_requests": parse_requests,
    "route_blocks": route_blocks,
    "route_requests": route_requests,
    "route_mappings": route_mappings,
    "route_summaries": route_summaries,
    "text_files_roundtrip": text_files_roundtrip,
    "route_landed_requests": route_landed_requests,
    "route_summaries_restored": route_summaries_restored,
    "gateway_audit": gateway_audit,
    "restore_responses": restore_responses,
    "restore_exact": _restored(restore_exact),
    "restore_transitive": _restored(restore),
    "restore_matcher": _restored(restore_fuzzy),
    "restore_fuzzy_spellings": restore_fuzzy_spellings,
    "restore_event_lines": restore_event_lines,
    "restore_conversation_scope": restore_conversation_scope,
    "restore_corpus_logs": restore_corpus_logs,
    "restore_corpus": restore_corpus,
    "unresolved_tokens": unresolved_in_texts,
    "unresolved_corpus": unresolved_corpus,
    "audit_recent": audit_recent,
    "audit_by_agent_since": audit_by_agent_since,
    "audit_summary": audit_summary,
    "audit_summary_since": audit_summary_since,
    "audit_redaction_totals": audit_redaction_totals,
    "audit_rotate_retained": audit_rotate_retained,
    "audit_store_rotation": audit_store_rotation,
    "audit_mixed_append": audit_mixed_append,
    "audit_rotate_late": audit_rotate_late,
    "audit_since_partitioned": audit_since_partitioned,
    "stream_redact": stream_redact,
    "stream_route": stream_route,
    "stream_chunk_restore": stream_chunk_restore,
    "chunk_restore": chunk_restore,
    "chunk_restore_irregular": chunk_restore_irregular,
    "chunk_restore_fuzzy": chunk_restore_fuzzy,
    "stream_audit_tail": stream_audit_tail,
    "stream_conversation_scope": stream_conversation_scope,
    "stream_scope_mapping": stream_scope_mapping,
    "stream_chunk_late_mapping": stream_chunk_late_mapping,
    "stream_chunk_broken_off": stream_chunk_broken_off,
}

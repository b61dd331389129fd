"""The registered queries in DuckDB's dialect.

DuckDB's regexes are RE2, the dialect the catalog is written in, so the patterns
go in unchanged and check the translation that Spark uses.  Rules are written out
by an independent glob translation.
"""

from __future__ import annotations

import re

from palimpsest.functions.patterns import (
    CATALOG,
    Pattern,
    all_patterns,
    custom_pattern,
    default_patterns,
    patterns_for_toggles,
    patterns_named,
)
from palimpsest.operators.rules import RuleSet
from palimpsest.plans.presets import load_rules
from suite import derived
from suite.queries import CUSTOM, HOME, PROJECT_CONFIG, STRUCTURE, TOGGLES, USER_CONFIG

_MARK = chr(0xE000)


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- detection and tokenization ---


def _three_groups(p: Pattern) -> str:
    """``head(value)tail`` as ``(head)(value)(tail)`` for the structure patterns."""
    flags, body = re.match(r"^(\(\?[a-z]+\))?(.*)$", p.regex, re.S).groups()
    start = re.search(r"(?<!\\)\((?!\?(?!P<))", body).start()
    end = body.index(")", start) + 1
    return f"{flags or ''}({body[:start]}){body[start:end]}({body[end:]})"


def _replace(text: str, p: Pattern, before: str, value: bool, after: str) -> str:
    if p.group:
        middle = "\\2" if value else ""
        return f"regexp_replace({text}, {_lit(_three_groups(p))}, {_lit(f'\\1{before}{middle}{after}\\3')}, 'g')"
    middle = "\\0" if value else ""
    return f"regexp_replace({text}, {_lit(p.regex)}, {_lit(before + middle + after)}, 'g')"


def _found(text: str, p: Pattern) -> str:
    return f"regexp_extract_all({text}, {_lit(p.regex)}{f', {p.group}' if p.group else ''})"


def _hits(source: str, key: str, text: str, patterns) -> str:
    parts = [
        f"SELECT {key}, {_lit(p.name)} AS pattern, {_lit(p.category)} AS category, {_found(text, p)} AS found FROM {source}"
        for p in patterns
    ]
    return " UNION ALL ".join(parts)


def _hits_long(source: str, key: str, text: str, patterns) -> str:
    return f"""SELECT {key}, pattern, category, unnest(range(len(found)))::INT AS pos, unnest(found) AS value
FROM ({_hits(source, key, text, patterns)})"""


def _counts(source: str, text: str, patterns) -> str:
    return f"""SELECT pattern, sum(len(found))::BIGINT AS matches, count(*) AS texts
FROM ({_hits(source, '1 AS k', text, patterns)}) WHERE len(found) > 0 GROUP BY pattern"""


def _masked(text: str, patterns) -> str:
    for p in patterns:
        text = _replace(text, p, f"[TG:{p.category}]", False, "")
    return text


def _fold(source: str, key: str, text: str, patterns, shaped: bool = False) -> str:
    """CTEs that end in ``folded(key, source text, t, mv, mt, pn, pc)``; ``shaped`` if the texts have token-shaped parts."""
    ctes = [
        f"s0 AS (SELECT {key}, {text} AS original, {text} AS t, []::VARCHAR[] AS mv, []::VARCHAR[] AS mt, "
        f"[]::VARCHAR[] AS pn, []::INT[] AS pc FROM {source})"
    ]
    for k, p in enumerate(patterns, 1):
        rest = f"{key}, original, mv, mt, pn, pc"
        head = f"[TG:{p.category}:"
        spelled = f"regexp_extract_all(original, 'TG[:_]{p.category}[:_]([0-9]{{1,9}})(?:[^0-9]|$)', 1)::INT[]"
        taken = f" + coalesce(list_max({spelled}), 0)" if shaped else ""
        ctes += [
            f"m{k} AS (SELECT {rest}, string_split({_replace('t', p, _MARK, True, _MARK)}, {_lit(_MARK)}) AS pcs FROM s{k - 1})",
            f"f{k} AS (SELECT *, list_filter(pcs, lambda x, i: i % 2 = 0) AS v FROM m{k})",
            f"n{k} AS (SELECT *, list_filter(v, lambda x, i: list_position(v, x) = i AND NOT list_contains(mv, x)) AS fr, "
            f"len(list_filter(mt, lambda y: starts_with(y, {_lit(head)}))){taken} AS used FROM f{k})",
            f"a{k} AS (SELECT {key}, original, pcs, mv || fr AS mv, "
            f"mt || list_transform(fr, lambda x, i: {_lit(head)} || (used + i)::VARCHAR || ']') AS mt, "
            f"CASE WHEN len(v) > 0 THEN pn || [{_lit(p.name)}] ELSE pn END AS pn, "
            f"CASE WHEN len(v) > 0 THEN pc || [len(v)::INT] ELSE pc END AS pc FROM n{k})",
            f"s{k} AS (SELECT {key}, original, array_to_string(list_transform(pcs, lambda x, i: "
            f"CASE WHEN i % 2 = 0 THEN mt[list_position(mv, x)] ELSE x END), '') AS t, mv, mt, pn, pc FROM a{k})",
        ]
    ctes.append(f"folded AS (SELECT * FROM s{len(patterns)})")
    return "WITH " + ",\n".join(ctes) + "\n"


def _texts(key: str) -> str:
    return f"SELECT {key}, t AS text, coalesce(list_sum(pc), 0)::INT AS matches, len(mt)::INT AS values FROM folded"


def _mapping(key: str) -> str:
    return f"""SELECT {key}, unnest(range(len(mt)))::INT AS ord, unnest(mt) AS token,
 split_part(unnest(mt), ':', 2) AS category, unnest(mv) AS value FROM folded"""


ALL = list(CATALOG)
TRAINING = load_rules("training-data").enabled_patterns()
DESKTOP = load_rules("desktop").enabled_patterns()
LOGS = f"(SELECT event_id, {derived.EVENT_LOG} AS text FROM events)"
DOCS = _fold("documents", "doc_id, lang, source", "text", TRAINING)
LOG_FOLD = _fold(LOGS, "event_id", "text", ALL)

# The same total per pattern and overall, as Spark's rollup gives it.
_SUMMARY = """, hits AS (SELECT unnest(pn) AS pattern, unnest(pc) AS c FROM folded)
SELECT pattern, sum(c)::BIGINT AS n FROM hits GROUP BY pattern
UNION ALL SELECT 'TOTAL', sum(c)::BIGINT FROM hits HAVING count(*) > 0"""

_LINES = """, lines AS (SELECT {key}, string_split(original, chr(10)) AS b, string_split(t, chr(10)) AS a FROM folded),
pairs AS (SELECT {key}, b, a, unnest(range(1, greatest(len(b), len(a)) + 1)) AS line FROM lines),
shown AS (SELECT {key}, line::INT AS line, coalesce(b[line], '') AS before, coalesce(a[line], '') AS after FROM pairs)
"""

# Values of a conversation are numbered by first appearance: turn, pattern, position.
_TURNS = f"(SELECT conv_id, turn, {derived.TURN_TEXT} AS text FROM conversations)"
_EMAIL, _IPV4 = (next(p for p in CATALOG if p.name == n) for n in ("email", "ipv4"))
_SCOPE = f"""WITH turns AS {_TURNS},
found AS (
 SELECT conv_id, turn, 1 AS p, 'EMAIL' AS category, {_found('text', _EMAIL)} AS v FROM turns
 UNION ALL SELECT conv_id, turn, 2, 'IP', {_found('text', _IPV4)} FROM turns),
one AS (SELECT conv_id, turn, p, category, unnest(range(len(v))) AS pos, unnest(v) AS value FROM found),
firsts AS (SELECT conv_id, value, min({{'t': turn, 'p': p, 'i': pos}}) AS f, arg_min(category, {{'t': turn, 'p': p, 'i': pos}}) AS category
 FROM one GROUP BY conv_id, value),
numbered AS (SELECT conv_id, value, category, row_number() OVER (PARTITION BY conv_id, category ORDER BY f)::INT AS n FROM firsts),
tokens AS (SELECT *, '[TG:' || category || ':' || n::VARCHAR || ']' AS token FROM numbered)
"""


def _exchange(text: str, p: Pattern) -> str:
    pieces = f"string_split({_replace(text, p, _MARK, True, _MARK)}, {_lit(_MARK)})"
    return (
        f"array_to_string(list_transform({pieces}, lambda x, i: CASE WHEN i % 2 = 0 THEN toks[list_position(vals, x)] ELSE x END), '')"
    )


# --- rules ---


def _glob(glob: str) -> str:
    """A glob as an RE2 body: the few forms that the rules in use have."""
    out = ""
    for piece in re.findall(r"^\*\*/|/\*\*/|/\*\*$|\*+|\?|\{[^}]*\}|\[[^\]]*\]|[^*?{\[/]+|/", glob):
        if piece == "**/":
            out += "(?:.*/)?"
        elif piece == "/**/":
            out += "/(?:.*/)?"
        elif piece == "/**":
            out += "(?:/.*)?"
        elif piece.startswith("*"):
            out += "[^/]*"
        elif piece.startswith("{"):
            out += "(?:" + piece[1:-1].replace(",", "|") + ")"
        elif piece.startswith("["):
            out += piece
        else:
            out += re.sub(r"([.+()|^$])", r"\\\1", piece)
    return out


def _last_match(column: str, rules) -> str:
    """Tier and source of the last rule of a layer that matches, as ``tier|source``."""
    whens = " ".join(
        f"WHEN regexp_full_match({column}, {_lit(_glob(r.pattern))}) THEN {_lit(f'{r.tier}|{r.source}')}" for r in reversed(rules)
    )
    return f"CASE {whens} END" if whens else "NULL"


def _resolved(column: str, rules) -> str:
    layer = {k: _last_match(column, [r for r in rules if r.layer == k]) for k in (1, 2, 3, 4)}
    return (
        f"coalesce({layer[4]}, {layer[3]}, CASE WHEN {layer[1]} LIKE '3|%' THEN {layer[1]} "
        f"ELSE coalesce({layer[2]}, {layer[1]}) END)"
    )


def _expanded(path: str) -> str:
    """Home expansion; the derived paths go up at most two levels below home."""
    return (
        f"CASE WHEN {path} LIKE '~/projects/internal/../../%' THEN {_lit(HOME)} || substr({path}, 26) "
        f"WHEN {path} LIKE '~/%' THEN {_lit(HOME)} || substr({path}, 2) "
        f"WHEN {path} LIKE '~%/%' THEN '/home/' || substr({path}, 2) ELSE {path} END"
    )


_TIER_NAME = "CASE split_part(v, '|', 1) WHEN '0' THEN 'public' WHEN '1' THEN 'redacted' WHEN '2' THEN 'local-only' ELSE 'blocked' END"
_VERDICT = f"split_part(v, '|', 1)::INT AS tier, {_TIER_NAME} AS tier_name, split_part(v, '|', 2) AS source"
_PATHS = f"""paths AS (SELECT doc_id, path, agent, {_expanded('path')} AS x
 FROM (SELECT doc_id, {derived.DOC_PATH} AS path, {derived.DOC_AGENT} AS agent FROM documents))"""


def _classified(rules: RuleSet, column: str = "x") -> str:
    return f"coalesce({_resolved(column, rules.of('path'))}, '0|default')"


def _classified_for_agent(rules: RuleSet) -> str:
    own = " ".join(
        f"WHEN {_lit(a)} THEN {_resolved('x', rules.of('path', a))} || {_lit(f' (agent:{a})')}" for a in rules.agents("path")
    )
    return f"coalesce(CASE agent {own} END, {_classified(rules)})"


SERVER = load_rules("server", home=HOME)
LAYERED = load_rules("server", user=USER_CONFIG, project=PROJECT_CONFIG, home=HOME)


def _preset(name: str) -> str:
    rules = load_rules(name, home=HOME)
    return f"WITH {_PATHS}, judged AS (SELECT *, {_classified(rules)} AS v FROM paths) SELECT doc_id, path, {_VERDICT} FROM judged"


def _command(rules: RuleSet, column: str) -> str:
    denied = ["cat /etc/shadow", "cat /etc/passwd", "cat ~/.ssh", "cat /root/.ssh", "cat .env", "sudo cat", "sudo -a cat", ".env"]
    logged = ["journalctl", "dmesg", "cat /var/log", "tail /var/log", "less /var/log"]
    any_of = lambda words: " OR ".join(f"contains(lower({column}), {_lit(w)})" for w in words)
    return (
        f"coalesce({_resolved(f'trim({column})', rules.of('cmd'))}, "
        f"CASE WHEN {any_of(denied)} THEN '2|cmd-denylist' WHEN {any_of(logged)} THEN '1|cmd-denylist' END)"
    )


# Words of a message that are paths, numbered.
_WORDS = r"""words AS (SELECT conv_id, turn, unnest(range(len(w))) AS place, unnest(w) AS word
 FROM (SELECT conv_id, turn, regexp_split_to_array(content, '[\s\x{85}\x{a0}]+') AS w FROM msgs)),
trimmed AS (SELECT conv_id, turn, place, regexp_replace(word, '[:;,.!?"''()\[\]{}]+$', '') AS path FROM words),
seen AS (SELECT conv_id, turn, path, min(place) AS place FROM trimmed
 WHERE len(path) >= 2 AND (starts_with(path, '/') OR regexp_matches(path, '^~[^~].*/') OR starts_with(path, '~/')) GROUP BY ALL)"""
_MSGS = f"msgs AS (SELECT conv_id, turn, {derived.MESSAGE_0} AS content FROM conversations)"

# --- requests: the blocks of each request, without going through JSON ---
_NESTED = f"{derived.MESSAGE_1_TEXT} || chr(10) || {derived.MESSAGE_1_NESTED} || chr(10)"
_BLOCKS = f"""blocks AS (
 SELECT {derived.REQUEST_ID} AS request_id, conv_id, turn, 0 AS idx, role, {derived.MESSAGE_0} AS content, '' AS file_path, '' AS command,
  false AS is_tool_result FROM conversations
 UNION ALL SELECT {derived.REQUEST_ID}, conv_id, turn, 1, 'assistant', {_NESTED}, '/var/log/nginx/error.log', '', true FROM conversations
 UNION ALL SELECT {derived.REQUEST_ID}, conv_id, turn, 2, 'tool', {derived.MESSAGE_2}, '',
  substr(split_part({derived.MESSAGE_2}, chr(10), 1), 6), true FROM conversations)"""
_CONTENT_TIER = f"""{_MSGS}, {_WORDS},
tiers AS (SELECT conv_id, turn, max(split_part({_classified(SERVER, _expanded('path'))}, '|', 1)::INT) AS tier FROM seen GROUP BY ALL)"""
_JUDGED = f"""{_BLOCKS}, {_CONTENT_TIER},
judged AS (SELECT b.*, CASE idx
 WHEN 0 THEN CASE WHEN coalesce(t.tier, 0) > 0 THEN t.tier::VARCHAR || '|pattern|content contains sensitive patterns or paths'
   ELSE '0|default|no rules matched' END
 WHEN 1 THEN {_classified(SERVER, 'file_path')} || '|matched path rule: ' || file_path
 ELSE coalesce({_command(SERVER, 'command')} || '|matched command rule: ' || command, '0|default|no rules matched') END AS v
 FROM blocks b LEFT JOIN tiers t USING (conv_id, turn)),
acted AS (SELECT *, split_part(v, '|', 1)::INT AS tier, split_part(v, '|', 2) AS source, split_part(v, '|', 3) AS reason FROM judged)"""


def _request_scope(tiers: str = "tier = 1", content: str = "content") -> str:
    """Tokens per request: the patterns that the requests contain, over their redacted blocks."""
    return f"""active AS (SELECT *, {content} AS scanned FROM acted WHERE {tiers}),
found AS (
 SELECT request_id, idx, 1 AS p, 'email' AS pattern, 'EMAIL' AS category, {_found('scanned', _EMAIL)} AS v FROM active
 UNION ALL SELECT request_id, idx, 2, 'ipv4', 'IP', {_found('scanned', _IPV4)} FROM active),
one AS (SELECT request_id, idx, p, category, unnest(range(len(v))) AS pos, unnest(v) AS value FROM found),
firsts AS (SELECT request_id, value, min({{'t': idx, 'p': p, 'i': pos}}) AS f, arg_min(category, {{'t': idx, 'p': p, 'i': pos}}) AS category
 FROM one GROUP BY request_id, value),
tokens AS (SELECT request_id, value, f, '[TG:' || category || ':' || (row_number() OVER (PARTITION BY request_id, category ORDER BY f))::VARCHAR || ']' AS token FROM firsts),
lists AS (SELECT request_id, list(value ORDER BY f) AS vals, list(token ORDER BY f) AS toks FROM tokens GROUP BY request_id),
done AS (SELECT a.request_id, a.idx, {_exchange(_exchange('scanned', _EMAIL), _IPV4)} AS redacted
 FROM active a LEFT JOIN lists l USING (request_id))"""


_NEW = """CASE tier WHEN 3 THEN '[access denied: blocked content]' WHEN 2 THEN '[local-only content withheld: no local model]'
 WHEN 1 THEN redacted END"""
_ROUTED = f"WITH {_JUDGED}, {_request_scope()}, routed AS (SELECT a.*, {_NEW} AS new_content FROM acted a LEFT JOIN done d USING (request_id, idx))"
_PROVIDER = "CASE turn % 4 WHEN 3 THEN 'openai' ELSE 'anthropic' END"

# --- audit ---
_AUDIT = "audit AS (SELECT " + ", ".join(f"({e}) AS {n}" for n, e in derived.AUDIT_COLUMNS.items()) + " FROM events)"
_HAS = "coalesce(redactions <> '' AND redactions <> 'null', false)"


def _audit_summary(where: str) -> str:
    one = "SELECT '{0}' AS dimension, {0} AS key, count(*) AS entries, count(*) FILTER (" + _HAS + ") AS redacted FROM a GROUP BY {0}"
    return (
        f"WITH {_AUDIT}, a AS (SELECT * FROM audit {where}) "
        + " UNION ALL ".join(one.format(d) for d in ("tier", "agent", "provider"))
        + f" UNION ALL SELECT 'total', '', count(*), count(*) FILTER ({_HAS}) FROM a"
    )


_PART = "CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20 12:00:00' THEN 'archived' ELSE 'retained' END"

_EMAIL_IN_URL = r"(\[TG:EMAIL:[0-9]+\])"

ORACLES: dict[str, str] = {
    "detect_counts_by_pattern": _counts("documents", "text", ALL),
    "detect_counts_logs": _counts(LOGS, "text", ALL),
    "detect_hits_long": _hits_long("documents", "doc_id", "text", ALL),
    "detect_hits_pages": _hits_long("pages", "page_id", "html", ALL),
    "mask_typed": f"SELECT doc_id, {_masked('text', ALL)} AS masked FROM documents",
    "mask_logs": f"SELECT event_id, {_masked('text', ALL)} AS masked FROM {LOGS}",
    "redact_numbered": DOCS + _texts("doc_id"),
    "redact_mapping": DOCS + _mapping("doc_id"),
    "redact_html": _fold("pages", "page_id", "html", default_patterns()) + _texts("page_id"),
    "redact_logs": LOG_FOLD + _texts("event_id"),
    "redact_logs_mapping": LOG_FOLD + _mapping("event_id"),
    "redact_logs_defaults": _fold(LOGS, "event_id", "text", DESKTOP) + _texts("event_id"),
    "redact_toggles": _fold(LOGS, "event_id", "text", patterns_for_toggles(TOGGLES)) + _texts("event_id"),
    "structure_patterns": _fold(LOGS, "event_id", "text", patterns_named(STRUCTURE)) + _texts("event_id"),
    "redact_custom_pattern": """SELECT c_custkey, 'Customer#[TG:CUST:1] / ' || c_mktsegment || ' / Customer#[TG:CUST:1]' AS text,
 2 AS matches, 1 AS values FROM customer""",
    "redact_conversation_scope": _SCOPE
    + f""", lists AS (SELECT conv_id, list(value) AS vals, list(token) AS toks FROM tokens GROUP BY conv_id),
matches AS (SELECT conv_id, turn, sum(len(v))::INT AS matches FROM found GROUP BY conv_id, turn)
SELECT conv_id, turn, {_exchange(_exchange('text', _EMAIL), _IPV4)} AS redacted, matches
FROM turns JOIN lists USING (conv_id) JOIN matches USING (conv_id, turn)""",
    "conversation_scope_mapping": _SCOPE + "SELECT conv_id, token, category, n, value FROM tokens",
    "corpus_summary": DOCS + _SUMMARY,
    "corpus_summary_logs": LOG_FOLD + _SUMMARY,
    "summary_by_lang_source": DOCS
    + """, per AS (SELECT lang, source, coalesce(list_sum(pc), 0) AS n FROM folded)
SELECT lang, source, count(*) AS docs, sum(n)::BIGINT AS matches, count(*) FILTER (n > 0) AS docs_with_hits
FROM per GROUP BY GROUPING SETS ((lang, source), (lang), ())""",
    "roundtrip_check": """SELECT 'documents' AS corpus, count(*) AS texts, count(*) AS identical FROM documents
UNION ALL SELECT 'logs', count(*), count(*) FROM events""",
    "dryrun_changed_lines": DOCS + _LINES.format(key="doc_id") + "SELECT * FROM shown WHERE before <> after",
    "dryrun_all_lines": LOG_FOLD + _LINES.format(key="event_id") + "SELECT *, before <> after AS changed FROM shown",
    "toxic_quality_vs_pii": DOCS
    + """, per AS (SELECT doc_id, coalesce(list_sum(pc), 0) AS n FROM folded)
SELECT quality, toxic, count(*) AS docs, count(*) FILTER (n > 0) AS docs_with_hits, sum(n)::BIGINT AS matches
FROM per JOIN labels USING (doc_id) GROUP BY quality, toxic""",
    "classify_url_paths": r"""WITH paths AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages),
judged AS (SELECT *, CASE WHEN path LIKE '/en/%' OR path = '/en' THEN '1|project'
 WHEN regexp_full_match(path, '/fr/[^/]*[02468]') THEN '2|project'
 WHEN regexp_full_match(path, '/(?:de|es)(?:/.*)?') THEN '3|project' ELSE '0|default' END AS v FROM paths)
SELECT page_id, path, """ + _VERDICT + " FROM judged",
    "classify_desktop": _preset("desktop"),
    "classify_server": _preset("server"),
    "classify_paranoid": _preset("paranoid"),
    "classify_training_data": _preset("training-data"),
    "classify_path_layers": f"WITH {_PATHS}, judged AS (SELECT *, {_classified(LAYERED)} AS v FROM paths) SELECT doc_id, path, {_VERDICT} FROM judged",
    "classify_agent_override": f"""WITH {_PATHS}, judged AS (SELECT *, {_classified_for_agent(LAYERED)} AS v FROM paths)
SELECT doc_id, agent, path, {_VERDICT} FROM judged""",
    "classify_report": f"""WITH {_PATHS}, judged AS (SELECT DISTINCT path, {_classified(SERVER)} AS v FROM paths)
SELECT path, {_TIER_NAME} AS tier, split_part(v, '|', 2) AS source, split_part(v, '|', 1) = '1' AS redaction_applies FROM judged""",
    "classify_commands": f"""WITH c AS (SELECT event_id, {derived.EVENT_COMMAND} AS command FROM events),
judged AS (SELECT *, coalesce({_command(load_rules('server', project=PROJECT_CONFIG, home=HOME), 'command')}, '0|default') AS v FROM c)
SELECT event_id, command, {_VERDICT} FROM judged""",
    "extract_paths": f"""WITH {_MSGS}, {_WORDS}
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY place) - 1)::INT AS pos, path FROM seen""",
    "escalate_block_tier": f"WITH {_CONTENT_TIER} SELECT conv_id, turn, coalesce(tier, 0) AS tier FROM msgs LEFT JOIN tiers USING (conv_id, turn)",
    "detect_agent": f"""WITH c AS (SELECT {derived.EVENT_HEADER} AS h, {derived.EVENT_USER_AGENT} AS u, lower({derived.EVENT_USER_AGENT}) AS l FROM events)
SELECT CASE WHEN h <> '' THEN h WHEN u IS NULL OR u = '' THEN 'unknown' WHEN contains(l, 'claude-code') THEN 'claude-code'
 WHEN contains(l, 'codex') THEN 'codex' WHEN contains(l, 'hermes') THEN 'hermes' WHEN contains(l, 'cursor') THEN 'cursor'
 WHEN contains(l, 'aider') THEN 'aider' WHEN contains(l, 'gh copilot') THEN 'github-copilot' WHEN contains(l, 'xai-cli') THEN 'grok-cli'
 ELSE 'ua:' || substr(u, 1, 40) END AS agent, count(*) AS n FROM c GROUP BY 1""",
    "resolve_provider": f"""WITH c AS (SELECT event_id, {derived.EVENT_PATH} AS path, {derived.EVENT_QUERY} AS query FROM events),
p AS (SELECT *, nullif(regexp_extract(path, '^/(anthropic|openai|xai|mistral)(?:/|$)', 1), '') AS provider FROM c)
SELECT event_id, provider, CASE provider WHEN 'anthropic' THEN 'api.anthropic.com' WHEN 'openai' THEN 'api.openai.com'
 WHEN 'xai' THEN 'api.x.ai' WHEN 'mistral' THEN 'api.mistral.ai' END AS host,
 substr(path, len(provider) + 2) || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS upstream_path FROM p""",
    "parse_requests": f"""WITH {_BLOCKS} SELECT request_id, idx, role, content, file_path, command,
 is_tool_result, role = 'system' AS is_system FROM blocks""",
    "route_blocks": _ROUTED
    + f"SELECT request_id, 'aider' AS agent, {_PROVIDER} AS provider, idx, tier, source, reason, new_content FROM routed",
    "route_requests": _ROUTED
    + f""", three AS (SELECT request_id, max(tier) = 3 AS blocked, list(coalesce(new_content, content) ORDER BY idx) AS c, list(new_content ORDER BY idx) AS n
 FROM routed GROUP BY request_id)
SELECT request_id, blocked, c[1] AS content_0, c[2] AS content_1, c[3] AS content_2, 't1' AS call_id, 'm' AS model FROM three""",
    "route_mappings": _ROUTED + "SELECT request_id, token, value FROM tokens",
    "route_summaries": f"""WITH {_JUDGED}, {_request_scope("tier = 1 OR (tier = 2 AND NOT contains(content, 'mysql'))",
    "CASE WHEN tier = 2 THEN right(content, 60) ELSE content END")}
SELECT a.request_id, a.idx, tier, CASE tier WHEN 3 THEN '[access denied: blocked content]'
 WHEN 2 THEN CASE WHEN contains(content, 'mysql') THEN '[local-only content could not be processed]' ELSE '[Local summary: ' || redacted || ']' END
 WHEN 1 THEN redacted END AS new_content FROM acted a LEFT JOIN done d USING (request_id, idx)""",
    "gateway_audit": _ROUTED
    + f""", counts AS (SELECT request_id, idx, pattern, len(v) AS n FROM found WHERE len(v) > 0),
json AS (SELECT request_id, idx, string_agg('"' || pattern || '":' || n::VARCHAR, ',' ORDER BY pattern) AS j FROM counts GROUP BY ALL)
SELECT r.request_id || '-' || r.idx::VARCHAR AS id, 'aider' AS agent, {_PROVIDER} AS provider, 'read' AS action, file_path AS target,
 CASE tier WHEN 0 THEN 'public' WHEN 1 THEN 'redacted' ELSE 'blocked' END AS tier,
 CASE WHEN tier = 1 THEN '{{' || coalesce(j, '') || '}}' END AS redactions, false AS approved,
 CASE tier WHEN 3 THEN 'blocked by rule: ' || source WHEN 2 THEN 'local model unavailable' END AS notes
FROM routed r LEFT JOIN json USING (request_id, idx)""",
    "restore_responses": _ROUTED
    + "SELECT request_id, coalesce(string_agg(content, ' | ' ORDER BY idx) FILTER (tier = 1), '') AS text FROM routed GROUP BY request_id",
    "restore_transitive": f"SELECT event_id, text FROM {LOGS}",
    "restore_exact": LOG_FOLD
    + r"""SELECT event_id, CASE WHEN event_id % 12 = 2 THEN replace(original, mv[list_position(mt, '[TG:EMAIL:1]')], '[TG:EMAIL:1]') ELSE original END AS text FROM folded""",
    "restore_matcher": LOG_FOLD
    + r"""SELECT event_id, CASE WHEN event_id % 12 = 2 THEN replace(original, mv[list_position(mt, '[TG:EMAIL:1]')], '[' || mv[list_position(mt, '[TG:EMAIL:1]')] || ']') ELSE original END AS text FROM folded""",
    "restore_fuzzy_spellings": LOG_FOLD
    + r"""SELECT event_id, array_to_string(list_transform(mv, lambda v: CASE WHEN event_id % 12 = 2 THEN
 replace(v, '[TG:EMAIL:1]', '[' || mv[list_position(mt, '[TG:EMAIL:1]')] || ']') ELSE v END), ' , ') AS text FROM folded""",
    "restore_event_lines": LOG_FOLD
    + r"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'data: ' || array_to_string(list_transform(mv, lambda v: CASE WHEN event_id % 12 = 2 THEN
 replace(v, '[TG:EMAIL:1]', '[' || mv[list_position(mt, '[TG:EMAIL:1]')] || ']') ELSE v END), ' ')
 ELSE 'event: ' || array_to_string(mt, ' ') END AS line FROM folded""",
    "unresolved_tokens": LOG_FOLD
    + r""", found AS (SELECT event_id, list_filter(regexp_extract_all(t, '\[TG:[A-Z]+:[0-9]+\]'),
  lambda x: list_position(mt, x) % 2 = 0) AS u FROM folded)
SELECT event_id, unnest(range(len(u)))::INT AS pos, unnest(u) AS token FROM found""",
    "unresolved_corpus": LOG_FOLD
    + r""", found AS (SELECT event_id, unnest(regexp_extract_all(t, '\[TG:[A-Z]+:[0-9]+\]')) AS token FROM folded)
SELECT event_id, token, count(*) AS n FROM found WHERE token LIKE '%1]' GROUP BY event_id, token""",
    "audit_recent": f"WITH {_AUDIT}, r AS (SELECT * FROM audit ORDER BY ts DESC, id DESC LIMIT 500) SELECT * EXCLUDE (ts) FROM r",
    "audit_by_agent_since": f"""WITH {_AUDIT} SELECT id, agent, tier, target, notes FROM audit
WHERE agent = 'agent-1' AND ts >= TIMESTAMP '2024-01-20'""",
    "audit_summary": _audit_summary(""),
    "audit_summary_since": _audit_summary("WHERE ts >= TIMESTAMP '2024-01-20'"),
    "audit_rotate_retained": f"""WITH {_AUDIT} SELECT {_PART} AS part, tier, count(*) AS n, min(id) AS first_id, max(id) AS last_id
FROM audit GROUP BY ALL""",
    "audit_store_rotation": f"""WITH {_AUDIT} SELECT {_PART} AS part, tier, count(*) AS n, count(*) FILTER ({_HAS}) AS redacted FROM audit GROUP BY ALL""",
    "audit_mixed_append": f"WITH {_AUDIT} SELECT id, agent, tier, target FROM audit",
    "audit_rotate_late": f"WITH {_AUDIT} SELECT CASE WHEN tier = 'redacted' THEN 'retained' ELSE {_PART} END AS part, id, tier FROM audit",
    "audit_since_partitioned": f"WITH {_AUDIT} SELECT id, agent, tier, target FROM audit WHERE ts >= TIMESTAMP '2024-01-20'",
    "stream_redact": _fold("documents", "doc_id", "text", ALL) + "SELECT doc_id, t AS text FROM folded",
    "stream_chunk_restore": f"SELECT {derived.REQUEST_ID} AS response_id, text FROM {_TURNS}",
    "restore_corpus": "SELECT doc_id, text FROM documents",
    "restore_corpus_logs": f"SELECT event_id, text FROM {LOGS}",
    "restore_conversation_scope": f"SELECT conv_id, turn, text FROM {_TURNS}",
    "route_summaries_restored": f"""WITH {_JUDGED}
SELECT request_id, idx, true AS own, 'summarized by local model' AS notes FROM acted WHERE tier = 2""",
    "route_landed_requests": f"""WITH r AS (SELECT {derived.REQUEST_ID} AS request_id FROM conversations)
SELECT request_id, 'team' AS agent, CASE WHEN ends_with(request_id, '1') THEN 0 ELSE 3 END::INT AS n,
 CASE WHEN ends_with(request_id, '1') THEN true END AS as_it_was FROM r WHERE NOT ends_with(request_id, '2')
UNION ALL SELECT 'malformed', '', count(*)::INT, true FROM r WHERE ends_with(request_id, '2')""",
    "text_files_roundtrip": f"SELECT conv_id || '/' || turn AS name, text FROM {_TURNS}",
    "chunk_restore": f"SELECT {derived.REQUEST_ID} AS response_id, text FROM {_TURNS}",
    "chunk_restore_irregular": f"SELECT {derived.REQUEST_ID} AS response_id, text FROM {_TURNS}",
    "stream_audit_tail": f"WITH {_AUDIT} SELECT id, tier, target FROM audit WHERE agent = 'agent-2'",
}
ORACLES["audit_redaction_totals"] = f"""WITH {_AUDIT}, r AS (SELECT json_extract(redactions, '$') AS j FROM audit WHERE {_HAS}),
k AS (SELECT unnest(json_keys(j)) AS pattern, j FROM r)
SELECT pattern, sum(json_extract(j, '$.' || pattern)::BIGINT)::BIGINT AS matches, count(*) AS entries FROM k GROUP BY pattern"""
ORACLES["stream_route"] = ORACLES["gateway_audit"].replace(
    "SELECT r.request_id || '-'", "SELECT id, tier, redactions FROM (SELECT r.request_id || '-'"
) + ")"
ORACLES["chunk_restore_fuzzy"] = (
    ORACLES["restore_fuzzy_spellings"].replace("SELECT event_id, array_to_string", "SELECT event_id::VARCHAR AS response_id, array_to_string")
    + " WHERE len(mt) > 0"
)

ORACLES["redact_custom_patterns"] = _fold(LOGS, "event_id", "text", [custom_pattern(*p) for p in CUSTOM]) + _texts("event_id")
_CODED = derived.encoded_text(lambda x: f"to_base64(encode({x}))")
ORACLES["redact_encoded"] = f"""SELECT event_id, {derived.ENCODED_REDACTED.format(nothing="to_base64(encode('nothing to see here, event ' || event_type))")} AS redacted,
 CASE event_id % 9 WHEN 3 THEN 2 WHEN 6 THEN 0 WHEN 8 THEN 0 ELSE 1 END AS encoded, CASE event_id % 9 WHEN 3 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 0 ELSE 1 END AS values,
 len({_CODED}) > 0 AS same FROM events"""
_SHAPED = f"(SELECT event_id, {derived.SHAPED_LOG} AS text FROM events)"
ORACLES["roundtrip_token_shaped"] = (
    _fold(_SHAPED, "event_id", "text", all_patterns()[::2], shaped=True)
    + "SELECT event_id, t AS once, original AS text, 0::INT AS clashes FROM folded"
)
ORACLES["stream_conversation_scope"] = ORACLES["redact_conversation_scope"]
ORACLES["stream_scope_mapping"] = ORACLES["conversation_scope_mapping"]
ORACLES["stream_chunk_late_mapping"] = ORACLES["stream_chunk_restore"]
ORACLES["stream_chunk_broken_off"] = _fold(_TURNS, "conv_id, turn", "text", ALL) + f""", ends AS (
 SELECT conv_id, turn, original, '203.0.113.' || turn::VARCHAR AS v, mt[list_position(mv, '203.0.113.' || turn::VARCHAR)] AS token FROM folded)
SELECT {derived.REQUEST_ID} AS response_id, substr(original, 1, len(original) - len(v)) || substr(token, 1, len(token) - 3) AS text FROM ends"""

# Each form of glob is a test of its own on the parts of a path.
ORACLES["classify_many_rules"] = f"""WITH r AS (SELECT {derived.MANY_LAYER} AS layer, event_id AS ord, {derived.MANY_PATTERN} AS p, {derived.MANY_TIER} AS tier,
 'rule ' || event_id::VARCHAR AS source, event_id % 6 AS form FROM events),
r1 AS (SELECT *, CASE form WHEN 0 THEN substr(p, 1, len(p) - 3) WHEN 1 THEN substr(p, 4) WHEN 2 THEN substr(p, 9) WHEN 3 THEN substr(p, 5) WHEN 4 THEN p
 ELSE substr(p, 4, len(p) - 6) END AS part FROM r),
r2 AS (SELECT layer, form, part, max({{'ord': ord, 'tier': tier, 'source': source}}) AS best FROM r1 GROUP BY ALL),
paths AS (SELECT DISTINCT {derived.MANY_PATH} AS path FROM events),
s AS (SELECT path, string_split(path, '/') AS seg FROM paths),
part AS (
 SELECT path, 0 AS form, array_to_string(seg[1:unnest(range(1, len(seg) + 1))], '/') AS part FROM s
 UNION SELECT path, 1, seg[-1] FROM s
 UNION SELECT path, 2, seg[-1] FROM s WHERE len(seg) = 4 AND seg[2] = 'data'
 UNION SELECT path, 3, substr(seg[-1], unnest(range(1, len(seg[-1]) + 1))) FROM s
 UNION SELECT path, 4, path FROM s
 UNION SELECT path, 5, unnest(seg) FROM s),
hit AS (SELECT path, layer, max(best) AS b FROM part JOIN r2 USING (form, part) GROUP BY path, layer),
wide AS (SELECT path, max(b) FILTER (layer = 1) AS a, max(b) FILTER (layer = 2) AS b, max(b) FILTER (layer = 3) AS c, max(b) FILTER (layer = 4) AS d
 FROM hit GROUP BY path),
v AS (SELECT path, coalesce(d, c, CASE WHEN a.tier = 3 THEN a ELSE coalesce(b, a) END) AS v FROM wide)
SELECT path, coalesce(v.tier, 0)::INT AS tier, coalesce(v.source, 'default') AS source FROM paths LEFT JOIN v USING (path)"""

_OWNED = "WITH k AS (SELECT " + ", ".join(f"({e}) AS {n}" for n, e in derived.KEY_COLUMNS.items()) + " FROM customer)"
ORACLES["detect_agent_fingerprint"] = f"""{_OWNED},
latest AS (SELECT api_key, max(registered_at) AS registered_at FROM k GROUP BY api_key),
owners AS (SELECT sha256(k.api_key) AS h, min(agent_name) AS owner FROM k JOIN latest l
 ON k.api_key = l.api_key AND k.registered_at IS NOT DISTINCT FROM l.registered_at GROUP BY 1),
c AS (SELECT event_id, {derived.EVENT_HEADER} AS h, {derived.EVENT_USER_AGENT} AS u, lower({derived.EVENT_USER_AGENT}) AS l, {derived.EVENT_KEY} AS key FROM events)
SELECT unnest(['small', 'large']) AS way, event_id, CASE WHEN c.h <> '' THEN c.h WHEN owner IS NOT NULL THEN owner WHEN u IS NULL OR u = '' THEN 'unknown'
 WHEN contains(l, 'claude-code') THEN 'claude-code' WHEN contains(l, 'codex') THEN 'codex' WHEN contains(l, 'hermes') THEN 'hermes'
 WHEN contains(l, 'cursor') THEN 'cursor' WHEN contains(l, 'aider') THEN 'aider' WHEN contains(l, 'gh copilot') THEN 'github-copilot'
 WHEN contains(l, 'xai-cli') THEN 'grok-cli' ELSE 'ua:' || substr(u, 1, 40) END AS agent
FROM c LEFT JOIN owners o ON key <> '' AND sha256(key) = o.h"""
_ID = "sha256({0}len(event_id::VARCHAR)::VARCHAR || ':' || event_id::VARCHAR || '|' || len(token)::VARCHAR || ':' || token)"
ORACLES["audit_unresolved"] = LOG_FOLD + rf""", found AS (SELECT event_id, unnest(regexp_extract_all(t, '\[TG:[A-Z]+:[0-9]+\]')) AS token FROM folded),
n AS (SELECT event_id, token, count(*) AS n FROM found GROUP BY ALL)
SELECT {_ID.format("")} AS id, 'agent-1' AS agent, 'unresolved_token' AS action, token AS target, n::VARCHAR || ' left in place' AS notes FROM n WHERE token LIKE '%1]'
UNION ALL SELECT {_ID.format("'6:stream|' || ")}, 'unknown', 'unresolved_token', token, n::VARCHAR || ' left in place' FROM n WHERE token LIKE '%2]'"""
# How many values each form has is known; quantiles go by rank, without a sketch.
ORACLES["bypass_risk"] = f"""WITH t AS (SELECT event_id, event_type AS source, ({_CODED}) || {derived.PADDING} AS text,
 CASE event_id % 9 WHEN 3 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 0 ELSE 1 END AS matches,
 CASE event_id % 9 WHEN 3 THEN 2 WHEN 6 THEN 0 WHEN 8 THEN 0 ELSE 1 END AS encoded FROM events),
d AS (SELECT event_id, source, matches, encoded, round(matches * 1000 / len(text), 6) AS density FROM t),
u AS (SELECT source, min(density) AS usual FROM (SELECT *, cume_dist() OVER (PARTITION BY source ORDER BY density) AS c FROM d) WHERE c >= 0.9 GROUP BY source)
SELECT event_id, source, density, matches, encoded, CASE WHEN matches >= 2 AND density > usual THEN CASE WHEN encoded > 0 THEN 'manual_review_recommended'
 ELSE 'high_redaction_density' END WHEN encoded > 0 THEN 'encoding_detected' ELSE 'none' END AS bypass_risk FROM d JOIN u USING (source)"""

ORACLES["audit_compacted"] = (
    ORACLES["audit_rotate_late"] + f" UNION ALL SELECT 'tail', id, tier FROM (WITH {_AUDIT} SELECT id, tier FROM audit)"
)

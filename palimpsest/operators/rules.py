"""Layered path and command rules.

A rule set is configuration, so it is a plain value on the driver and becomes
part of the expression: matching needs no join and no shuffle.  Within a layer
the last matching rule wins, hence neighbouring rules with the same outcome are
one regex alternation, and a layer of hundreds of globs costs a few ``rlike``.

Across layers the higher one wins, but a block of the defaults can only be
lifted by a layer a person wrote (user or project), not by a preset.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.dialect import globs_to_java
from palimpsest.functions.expr import let
from palimpsest.functions.patterns import Pattern, patterns_for_toggles
from palimpsest.functions.paths import SPACE, expand_home, expand_home_literal, extract_paths
from palimpsest.functions.tiers import BLOCKED, LOCAL_ONLY, PUBLIC, REDACTED, tier_name, tier_of_word

DEFAULTS, PRESET, USER, PROJECT = 1, 2, 3, 4
VERDICT = "struct<tier:int,source:string>"
# A rule table is read to the driver, as configuration; beyond this it is not one.
MAX_RULES = 100_000


@dataclass(frozen=True)
class Config:
    """The content of one layer.  ``commands`` are ``(glob, tier word)`` pairs."""

    block: tuple[str, ...] = ()
    local_only: tuple[str, ...] = ()
    redact: tuple[str, ...] = ()
    commands: tuple[tuple[str, str], ...] = ()
    patterns: Mapping[str, bool] = field(default_factory=dict)
    agents: Mapping[str, "Config"] = field(default_factory=dict)
    preset: str = ""


@dataclass(frozen=True)
class Rule:
    kind: str  # "path" or "cmd"
    agent: str  # "" for every agent
    layer: int
    pattern: str
    tier: int
    source: str


@dataclass(frozen=True)
class RuleSet:
    """All rules in order, lowest layer first, and the resolved pattern toggles."""

    rules: tuple[Rule, ...]
    toggles: Mapping[str, bool] = field(default_factory=dict)
    preset: str = ""
    home: str = "/root"

    def of(self, kind: str, agent: str = "") -> list[Rule]:
        return [r for r in self.rules if r.kind == kind and r.agent == agent]

    def agents(self, kind: str) -> list[str]:
        return sorted({r.agent for r in self.rules if r.kind == kind and r.agent})

    def enabled_patterns(self) -> list[Pattern]:
        return patterns_for_toggles(self.toggles)


def _layer_rules(config: Config, layer: int, source: str, agent: str, home: str) -> list[Rule]:
    by_tier = ((BLOCKED, config.block), (LOCAL_ONLY, config.local_only), (REDACTED, config.redact))
    rules = [
        Rule("path", agent, layer, expand_home_literal(glob, home), tier, source)
        for tier, globs in by_tier
        for glob in globs
    ]
    for glob, word in config.commands:
        tier = tier_of_word(word)
        if tier is not None:
            rules.append(Rule("cmd", agent, layer, glob, tier, f"{source}:cmd"))
    return rules


def assemble(layers: Iterable[tuple[int, str, Config]], home: str) -> RuleSet:
    """Combine layers ``(level, source label, config)``, lowest first.

    Later layers override toggles.  Rules of an agent's section are kept apart
    and take precedence for that agent.
    """
    rules: list[Rule] = []
    toggles: dict[str, bool] = {}
    preset = ""
    for level, source, config in sorted(layers, key=lambda x: x[0]):
        toggles.update(config.patterns)
        preset = config.preset or preset
        rules += _layer_rules(config, level, source, "", home)
        for agent, section in config.agents.items():
            rules += _layer_rules(section, level, f"{source}:agent:{agent}", agent, home)
    return RuleSet(tuple(rules), toggles, preset, home)


def merge_configs(parent: Config, child: Config) -> Config:
    """One config out of two: rules are appended, the child's toggles and preset win."""
    agents = dict(parent.agents)
    for name, section in child.agents.items():
        agents[name] = merge_configs(agents[name], section) if name in agents else section
    return Config(
        block=parent.block + child.block,
        local_only=parent.local_only + child.local_only,
        redact=parent.redact + child.redact,
        commands=parent.commands + child.commands,
        patterns={**parent.patterns, **child.patterns},
        agents=agents,
        preset=child.preset or parent.preset,
    )


def rules_from_table(rules: DataFrame, home: str, toggles: Mapping[str, bool] | None = None) -> RuleSet:
    """A rule set from a table ``(kind, agent, layer, ord, pattern, tier, source)``.

    Rules are configuration and end up in the plan, so the table must be small;
    a larger one is refused rather than cut.
    """
    wanted = rules.select("kind", "agent", "layer", "ord", "pattern", "tier", "source")
    rows = wanted.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rows.sort(key=lambda r: (r["layer"], r["ord"]))
    return RuleSet(
        tuple(
            Rule(
                r["kind"],
                r["agent"] or "",
                r["layer"],
                expand_home_literal(r["pattern"], home) if r["kind"] == "path" else r["pattern"],
                r["tier"],
                r["source"],
            )
            for r in rows
        ),
        dict(toggles or {}),
        home=home,
    )


def _verdict(tier: int, source: str) -> Column:
    return F.struct(F.lit(tier).alias("tier"), F.lit(source).alias("source")).cast(VERDICT)


def _nothing() -> Column:
    return F.lit(None).cast(VERDICT)


def _layer_verdict(value: Column, rules: Sequence[Rule]) -> Column:
    """Outcome of the last matching rule of one layer, NULL if none matches."""
    result = None
    for (tier, source), run in reversed([(k, list(g)) for k, g in groupby(rules, key=lambda r: (r.tier, r.source))]):
        regex = globs_to_java([r.pattern for r in run])
        if regex is None:
            continue
        hit = value.rlike(regex)
        result = F.when(hit, _verdict(tier, source)) if result is None else result.when(hit, _verdict(tier, source))
    return _nothing() if result is None else result


def resolve(value: Column, rules: Sequence[Rule]) -> Column:
    """``struct<tier, source>`` of an expanded path or command, NULL if no rule matches."""
    if not rules:
        return _nothing()
    layers = {
        level: _layer_verdict(value, [r for r in rules if r.layer == level]) for level in {r.layer for r in rules}
    }
    human = [layers[level] for level in (PROJECT, USER) if level in layers]
    shipped: Column | None = None
    if DEFAULTS in layers and PRESET in layers:
        shipped = let(
            layers[DEFAULTS],
            lambda base: F.when(base["tier"] == BLOCKED, base).otherwise(F.coalesce(layers[PRESET], base)),
        )
    elif DEFAULTS in layers or PRESET in layers:
        shipped = layers.get(DEFAULTS, layers.get(PRESET))
    return F.coalesce(*human, *([shipped] if shipped is not None else []))


def _for_agent(value: Column, rule_set: RuleSet, kind: str, agent: Column | None) -> Column:
    general = resolve(value, rule_set.of(kind))
    if agent is None:
        return general

    def labelled(name: str) -> Column:
        def add_label(v: Column) -> Column:
            source = F.concat(v["source"], F.lit(f" (agent:{name})"))
            return F.when(v.isNotNull(), F.struct(v["tier"].alias("tier"), source.alias("source")))

        return let(resolve(value, rule_set.of(kind, name)), add_label)

    own = None
    for name in rule_set.agents(kind):
        own = F.when(agent == name, labelled(name)) if own is None else own.when(agent == name, labelled(name))
    return general if own is None else F.coalesce(own, general)


def match_path(path: Column, rule_set: RuleSet, agent: Column | None = None) -> Column:
    """``struct<tier, source>`` of a path, NULL if no rule matches it."""
    return let(expand_home(path, rule_set.home), lambda p: _for_agent(p, rule_set, "path", agent))


def classify_path(path: Column, rule_set: RuleSet, agent: Column | None = None) -> Column:
    """``struct<tier, source>`` of a path; public by default."""
    return F.coalesce(match_path(path, rule_set, agent), _verdict(PUBLIC, "default"))


def trim_space(text: Column) -> Column:
    """``text`` without Unicode white space at either end."""
    return F.regexp_replace(text, F.lit(rf"\A[{SPACE}]+|[{SPACE}]+\z"), F.lit(""))


def match_command(command: Column, rule_set: RuleSet, agent: Column | None = None) -> Column:
    """``struct<tier, source>`` of a command line, NULL if no command rule matches.

    Commands are expanded like paths, command globs are not.  An agent's own
    command rules come first.
    """
    if not any(r.kind == "cmd" for r in rule_set.rules):
        return _nothing()
    return let(
        expand_home(trim_space(command), rule_set.home),
        lambda c: F.when(c != "", _for_agent(c, rule_set, "cmd", agent)),
    )


# Commands that are restricted even if no rule mentions them.
_LOCAL_COMMANDS = (
    "cat /etc/shadow",
    "cat /etc/passwd",
    "cat ~/.ssh",
    "cat /root/.ssh",
    "cat .env",
    "sudo cat",
    "sudo -a cat",
    ".env",
)
_LOG_COMMANDS = ("journalctl", "dmesg", "cat /var/log", "tail /var/log", "less /var/log")
# End of fixed values.


def _any_of(text: Column, literals: Sequence[str]) -> Column:
    hit = F.lit(False)
    for literal in literals:
        hit = hit | F.contains(text, F.lit(literal))
    return hit


def command_floor(command: Column) -> Column:
    """What a command line gets when no rule matches: NULL unless it reads secrets or logs."""
    return let(
        F.lower(command),
        lambda c: F.when(_any_of(c, _LOCAL_COMMANDS), _verdict(LOCAL_ONLY, "cmd-denylist"))
        .when(_any_of(c, _LOG_COMMANDS), _verdict(REDACTED, "cmd-denylist"))
        .otherwise(_nothing()),
    )


def classify_command(command: Column, rule_set: RuleSet, agent: Column | None = None) -> Column:
    """``struct<tier, source>`` of a command line: rules, then the floor, then public."""
    return F.coalesce(
        match_command(command, rule_set, agent), command_floor(command), _verdict(PUBLIC, "default")
    )


def content_tier(text: Column, rule_set: RuleSet, agent: Column | None = None) -> Column:
    """The most restricted tier of the paths a text mentions."""
    tiers = F.transform(extract_paths(text), lambda p: match_path(p, rule_set, agent)["tier"])
    return F.coalesce(F.array_max(tiers), F.lit(PUBLIC))


def classify_block(
    content: Column,
    file_path: Column,
    command: Column,
    is_tool_result: Column,
    rule_set: RuleSet,
    agent: Column | None = None,
) -> Column:
    """``struct<tier, source, reason>`` of one content block.

    The first that decides wins: a tool result's command, the declared file path,
    the paths mentioned in the content.
    """
    shape = "struct<tier:int,source:string,reason:string>"

    def because(verdict: Column, reason: Column) -> Column:
        return let(
            verdict,
            lambda v: F.when(
                v.isNotNull(), F.struct(v["tier"].alias("tier"), v["source"].alias("source"), reason.alias("reason"))
            ).cast(shape),
        )

    by_command = F.when(
        is_tool_result & (command != ""),
        because(
            F.coalesce(match_command(command, rule_set, agent), command_floor(command)),
            F.concat(F.lit("matched command rule: "), command),
        ),
    )
    by_path = F.when(
        file_path != "",
        because(match_path(file_path, rule_set, agent), F.concat(F.lit("matched path rule: "), file_path)),
    )
    by_content = let(
        content_tier(content, rule_set, agent),
        lambda tier: F.when(
            tier > PUBLIC,
            F.struct(
                tier.alias("tier"),
                F.lit("pattern").alias("source"),
                F.lit("content contains sensitive patterns or paths").alias("reason"),
            ),
        ).cast(shape),
    )
    default = F.struct(
        F.lit(PUBLIC).alias("tier"), F.lit("default").alias("source"), F.lit("no rules matched").alias("reason")
    )
    return F.coalesce(by_command, by_path, by_content, default.cast(shape))


def classification_report(paths: DataFrame, column: str, rule_set: RuleSet) -> DataFrame:
    """One row per distinct path: tier, deciding rule layer, and whether redaction applies."""
    return (
        paths.select(F.col(column).alias("path"))
        .distinct()
        .withColumn("verdict", classify_path(F.col("path"), rule_set))
        .select(
            "path",
            tier_name(F.col("verdict.tier")).alias("tier"),
            F.col("verdict.source").alias("source"),
            (F.col("verdict.tier") == REDACTED).alias("redaction_applies"),
        )
    )

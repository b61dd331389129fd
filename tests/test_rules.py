import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.dialect import glob_body, globs_to_java, split_on_group, to_java
from palimpsest.functions.paths import expand_home, expand_home_literal, extract_paths
from palimpsest.functions.tiers import escalate, tier_name, tier_of_word
from palimpsest.operators.rules import (
    DEFAULTS,
    PRESET,
    PROJECT,
    USER,
    Config,
    assemble,
    classification_report,
    classify_block,
    classify_command,
    classify_path,
    content_tier,
    merge_configs,
    rules_from_table,
)
from palimpsest.plans.presets import PRESETS, choose_preset, load_rules

HOME = "/home/sid"


def tiers(spark, paths, rules, agent=None):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    verdict = classify_path(F.col("p"), rules, F.lit(agent) if agent else None)
    return [(r["v"]["tier"], r["v"]["source"]) for r in df.select("i", verdict.alias("v")).orderBy("i").collect()]


def one_layer(**config):
    return assemble([(USER, "user", Config(**config))], HOME)


def test_globs():
    cases = [
        ("**/.env", "project/.env", True), ("**/.env", ".env", True), ("**/.env", "a/b/.env", True), ("**/.env", "x.env", False),
        ("*.go", "main.go", True), ("*.go", "a/main.go", False), ("/var/log/**", "/var/log/a/b", True), ("/var/log/**", "/var/log", True),
        ("/var/log/**", "/var/logs", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a/**/b", "a/xb", False),
        ("a?c", "abc", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("[^a-c]x", "dx", True),
        ("{en,fr}/*", "fr/x", True), ("{en,fr}/*", "de/x", False), (r"a\*b", "a*b", True), (r"a\*b", "axb", False),
        ("a**b", "axxb", True), ("a**b", "a/b", False), ("mysql *", "mysql -u root", True), ("mysql *", "mysql -h /x", False),
        ("**", "a/b", True), ("a.b", "axb", False), ("{a,{b,c}}x", "cx", True), ("~/.config/chromium/Login Data", "~/.config/chromium/Login Data", True),
    ]
    for glob, path, want in cases:
        assert bool(re.fullmatch(glob_body(glob), path)) is want, (glob, path)
    for malformed in ("[a", "{a,b", "a\\", "[]x"):
        assert glob_body(malformed) is None
    assert globs_to_java(["[a"]) is None


def test_regex_dialect():
    assert to_java(r"\bx\b").count("(?<!") == 2
    assert to_java(r"(?m)^a").startswith("(?md)")
    assert to_java(r"a$") == r"a\z" and to_java(r"(?m)a$") == "(?md)a$"
    assert to_java(r"[\s.]") == r"[\t\n\f\r .]" and to_java(r"[^\s]+") == r"[^\t\n\f\r ]+"
    assert split_on_group(r"(?m)^a(b)c") == r"(?m)(^a)(b)(c)"
    assert split_on_group(r"(?:a|[(])(b(?:c))d") == r"((?:a|[(]))(b(?:c))(d)"


def test_home_expansion(spark):
    cases = {
        "~": HOME, "~/x": f"{HOME}/x", "~/": HOME, "~/a/../b//c/.": f"{HOME}/b/c", "~bob/x": "/home/bob/x", "~bob": "~bob",
        "/a/../b": "/a/../b", "a~": "a~", "~/../../etc/x": "/etc/x", "~bob/": "/home/bob", "": "",
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r["p"]: r["x"] for r in df.select("p", expand_home(F.col("p"), HOME).alias("x")).collect()}
    assert got == cases
    assert {p: expand_home_literal(p, HOME) for p in cases} == cases


def test_path_extraction(spark):
    cases = [
        ("I read /etc/shadow and ~/.zsh_history then checked /var/log/syslog", ["/etc/shadow", "~/.zsh_history", "/var/log/syslog"]),
        ("(/etc/shadow) ~~/x ~a/b, ~a / /! /x", ["~a/b", "/x"]),
        ("/a /b /c\n/a", ["/a", "/b", "/c"]),
        ("see '/x/y'", []), ("/a/b:;,.!?\"'()[]{}", ["/a/b"]), ("x/y a", []), ("", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = [r["p"] for r in df.select("i", extract_paths(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == [want for _, want in cases]


def test_basic_tiers(spark):
    rules = one_layer(block=("/etc/shadow", "~/.ssh/id_*"), local_only=("**/.env",), redact=("/var/log/**", "~/.zsh_history"))
    got = tiers(spark, ["/var/log/nginx/access.log", "project/.env", "/home/user/code/main.go", "~/.ssh/id_rsa"], rules)
    assert got == [(1, "user"), (2, "user"), (0, "default"), (3, "user")]


def test_later_lists_win_within_a_layer(spark):
    rules = one_layer(block=("~/.ssh/**",), redact=("~/.ssh/config",))
    assert tiers(spark, ["~/.ssh/config", "~/.ssh/id_rsa"], rules) == [(1, "user"), (3, "user")]


def test_block_is_sticky_for_presets_only(spark):
    base = (DEFAULTS, "defaults", Config(block=("~/.ssh/id_*",), redact=("/var/log/**",)))
    preset = (PRESET, "preset:x", Config(local_only=("~/**",)))
    user = (USER, "user", Config(redact=("~/.ssh/id_ed25519",), local_only=("/var/log/**",)))
    project = (PROJECT, "project", Config(block=("/var/log/**",)))
    paths = ["~/.ssh/id_ed25519", "~/x", "/var/log/a"]
    assert tiers(spark, paths, assemble([base, preset], HOME)) == [(3, "defaults"), (2, "preset:x"), (1, "defaults")]
    assert tiers(spark, paths, assemble([base, preset, user], HOME)) == [(1, "user"), (2, "preset:x"), (2, "user")]
    assert tiers(spark, paths, assemble([project, user, base], HOME))[2] == (3, "project")


def test_agent_override(spark):
    config = Config(
        redact=("~/projects/**",),
        agents={"codex": Config(block=("~/projects/company-internal/**",))},
    )
    rules = assemble([(USER, "user", config)], HOME)
    path = ["~/projects/company-internal/x", "~/projects/y"]
    assert tiers(spark, path, rules, "claude") == [(1, "user"), (1, "user")]
    assert tiers(spark, path, rules, "codex") == [(3, "user:agent:codex (agent:codex)"), (1, "user")]


def test_commands(spark):
    rules = load_rules("server", home=HOME)
    cases = [
        ("journalctl -u nginx", 1, "preset:server:cmd"), ("mysql -u root -p foo", 2, "preset:server:cmd"),
        ("cat /etc/shadow", 3, "preset:server:cmd"), ("ls -la", 0, "default"), ("  docker logs x ", 1, "preset:server:cmd"),
        ("CAT /ETC/PASSWD", 2, "cmd-denylist"), ("sudo cat x", 2, "cmd-denylist"), ("vi a/.env", 2, "cmd-denylist"),
        ("dmesg | tail", 1, "cmd-denylist"), ("mysql -h /x", 0, "default"), ("", 0, "default"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(cases)], "i int, c string")
    got = df.select("i", classify_command(F.col("c"), rules).alias("v")).orderBy("i").collect()
    assert [(r["v"]["tier"], r["v"]["source"]) for r in got] == [(t, s) for _, t, s in cases]
    # without configured commands the floor still holds
    bare = df.select("i", classify_command(F.col("c"), one_layer()).alias("v")).orderBy("i").collect()
    assert bare[2]["v"]["tier"] == 2 and bare[0]["v"]["tier"] == 1 and bare[1]["v"]["tier"] == 0


def test_an_agents_own_commands_count(spark):
    config = Config(commands=(("ls *", "redact"),), agents={"codex": Config(commands=(("ls *", "block"),))})
    rules = assemble([(USER, "user", config)], HOME)
    df = spark.createDataFrame([("codex",), ("aider",)], "a string")
    got = df.select(classify_command(F.lit("ls -la"), rules, F.col("a"))["tier"].alias("t")).collect()
    assert [r["t"] for r in got] == [3, 1]


def test_blocks(spark):
    rules = load_rules("server", home=HOME)
    cases = [
        (("x", "", "journalctl -u a", True), (1, "preset:server:cmd", "matched command rule: journalctl -u a")),
        (("x", "", "journalctl -u a", False), (0, "default", "no rules matched")),
        (("see ~/.ssh/id_rsa", "/var/log/syslog", "", False), (2, "preset:server", "matched path rule: /var/log/syslog")),
        (("I read /etc/shadow and ~/.zsh_history", "", "", False), (3, "pattern", "content contains sensitive patterns or paths")),
        (("x", "/nowhere", "ls", True), (0, "default", "no rules matched")),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, c string, f string, m string, t boolean")
    verdict = classify_block(F.col("c"), F.col("f"), F.col("m"), F.col("t"), rules)
    got = [tuple(r["v"]) for r in df.select("i", verdict.alias("v")).orderBy("i").collect()]
    assert got == [want for _, want in cases]
    assert df.select(content_tier(F.lit("a /etc/shadow /var/log/x"), rules)).first()[0] == 3


def test_presets_and_toggles():
    assert choose_preset() == "desktop" and choose_preset(" server ") == "server"
    assert choose_preset("", Config(preset="paranoid"), Config(preset="server")) == "paranoid"
    assert choose_preset("", None, Config(preset="server")) == "server"
    with pytest.raises(ValueError):
        choose_preset("nonsense")
    enabled = {p.name for p in load_rules("desktop").enabled_patterns()}
    assert {"syslog_hostname", "passwd_username", "email", "api_key_slack"} <= enabled and "iban" not in enabled
    assert len(load_rules("training-data").enabled_patterns()) == 27
    assert "email" not in {p.name for p in load_rules("server", user=Config(patterns={"email": False})).enabled_patterns()}
    assert set(PRESETS) == {"desktop", "server", "paranoid", "training-data"}


def test_merging_keeps_commands():
    merged = merge_configs(
        Config(block=("a",), commands=(("x", "block"),), patterns={"email": True}, preset="server", agents={"c": Config(block=("p",))}),
        Config(block=("b",), commands=(("y", "pass"),), patterns={"email": False}, agents={"c": Config(redact=("q",)), "d": Config()}),
    )
    assert merged.block == ("a", "b") and merged.commands == (("x", "block"), ("y", "pass"))
    assert merged.patterns == {"email": False} and merged.preset == "server"
    assert merged.agents["c"] == Config(block=("p",), redact=("q",)) and "d" in merged.agents


def test_rule_table(spark):
    table = spark.createDataFrame(
        [("path", None, 3, 2, "~/a/**", 1, "user"), ("path", None, 3, 1, "~/**", 3, "user"), ("path", "codex", 3, 0, "~/a/b", 2, "user")],
        "kind string, agent string, layer int, ord int, pattern string, tier int, source string",
    )
    rules = rules_from_table(table, HOME)
    assert tiers(spark, ["~/a/b", "~/c"], rules) == [(1, "user"), (3, "user")]
    assert tiers(spark, ["~/a/b"], rules, "codex") == [(2, "user (agent:codex)")]


def test_tier_words_and_names(spark):
    assert [tier_of_word(w) for w in ("Block", " local ", "redacted", "allow", "maybe")] == [3, 2, 1, 0, None]
    row = spark.range(1).select(tier_name(F.lit(2)).alias("a"), tier_name(F.lit(9)).alias("b"), escalate(F.lit(1), F.lit(3)).alias("c")).first()
    assert tuple(row) == ("local-only", "unknown", 3)


def test_report(spark):
    df = spark.createDataFrame([("/var/log/syslog",), ("/var/log/syslog",), ("/x",)], "p string")
    got = {tuple(r) for r in classification_report(df, "p", load_rules("desktop", home=HOME)).collect()}
    assert got == {("/var/log/syslog", "redacted", "defaults", True), ("/x", "public", "default", False)}

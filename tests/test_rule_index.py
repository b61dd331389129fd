import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.dialect import split_braces
from palimpsest.operators import rule_index
from palimpsest.operators.rule_index import classify_many, glob_keys
from palimpsest.operators.rules import classify_path, rules_from_table
from palimpsest.session import Workspace

HOME = "/home/me"
RULES = "kind string, agent string, layer int, ord int, pattern string, tier int, source string"


def _random_glob(rng):
    segment = ["a", "bc", "tmp", ".env", "*", "**", "k*", "*.pem", "a?c", "x[0-9]y", "{a,bc}", "lo{g,gs/x}", "*cre*", "\\*", "é*ü", "[", "", "long-name*end"]
    glob = "/".join(rng.choice(segment) for _ in range(rng.randrange(1, 5)))
    return rng.choice(["", "/", "/", "~/", "~bob/", "/a/"]) + glob


def _random_path(rng):
    segment = ["a", "bc", "tmp", ".env", "k1", "x.pem", "abc", "x5y", "logs", "log", "x", "secret", "*", "éaü", "long-name-1-end", "", "credit"]
    return rng.choice(["", "/", "/", "~/", "~bob/", "/a/"]) + "/".join(rng.choice(segment) for _ in range(rng.randrange(1, 6)))


def test_same_as_rules_in_the_expression(spark):
    rng = random.Random(8)
    rows = [
        (rng.choice(["path"] * 9 + ["cmd"]), rng.choice(["", "", "codex", "hermes"]), rng.randrange(1, 5), i, _random_glob(rng), rng.randrange(1, 4), f"s{i}")
        for i in range(300)
    ]
    paths = [(_random_path(rng), rng.choice(["codex", "hermes", "other", None])) for _ in range(600)]
    rules = spark.createDataFrame(rows, RULES).repartition(4)
    frame = spark.createDataFrame([*paths, *paths[:50], (None, "codex"), ("", "codex")], "p string, a string")
    rule_set = rules_from_table(rules, HOME)
    for agent in (None, "a"):
        verdict = classify_path(F.col("p"), rule_set, None if agent is None else F.coalesce("a", F.lit("")))
        keep = ["p"] if agent is None else ["p", F.coalesce("a", F.lit(""))]
        want = frame.filter("p IS NOT NULL").withColumn("v", verdict).select(*keep, "v.tier", "v.source").distinct().collect()
        got = classify_many(frame, "p", rules, HOME, agent).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_without_rules_all_is_public(spark):
    frame = spark.createDataFrame([("/a",)], "p string")
    assert [tuple(r) for r in classify_many(frame, "p", spark.createDataFrame([], RULES), HOME).collect()] == [("/a", 0, "default")]
    assert classify_many(frame.limit(0), "p", spark.createDataFrame([("path", "", 1, 1, "/a", 3, "x")], RULES), HOME).collect() == []


def test_no_path_is_held_against_every_rule(spark):
    rules = spark.range(3000).select(
        F.lit("path").alias("kind"), F.lit("").alias("agent"), F.lit(3).alias("layer"), F.col("id").alias("ord"),
        F.concat(F.lit("/home/*/p"), "id", F.lit("/**")).alias("pattern"), F.lit(1).alias("tier"), F.lit("s").alias("source"),
    )
    paths = spark.range(3000).select(F.concat(F.lit("/home/u/p"), "id", F.lit("/x")).alias("p"))
    done = classify_many(paths, "p", rules, HOME)
    assert done.filter("tier = 1").count() == 3000
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_rules_with_one_glob_meet_a_path_once(spark):
    rules = spark.range(3000).select(
        F.lit("path").alias("kind"), F.lit("").alias("agent"), (F.col("id") % 2 + 3).alias("layer"), F.col("id").alias("ord"),
        F.concat(F.lit("**/*-secret"), F.col("id") % 3, F.lit(".pem")).alias("pattern"), (F.col("id") % 3 + 1).alias("tier"),
        F.concat(F.lit("s"), "id").alias("source"),
    )
    paths = spark.range(300).select(F.concat(F.lit("/u"), "id", F.lit("/a-secret"), F.col("id") % 4, F.lit(".pem")).alias("p"))
    assert rule_index.deciding_rules(rules).count() == 6
    space = Workspace(spark)
    met = rule_index._met(rule_index.index_globs(rules, HOME, space), paths.withColumnRenamed("p", "full"), space)
    assert met.count() == 225
    got = {r["path"]: (r["tier"], r["source"]) for r in classify_many(paths, "p", rules, HOME).collect()}
    last = {i % 3: i for i in range(2994, 3000) if i % 2}
    assert got == {f"/u{i}/a-secret{i % 4}.pem": (i % 4 + 1, f"s{last[i % 4]}") if i % 4 < 3 else (0, "default") for i in range(300)}


@pytest.mark.parametrize("few", [0, 1000])
def test_three_characters_when_all_other_keys_are_common(spark, monkeypatch, few):
    monkeypatch.setattr(rule_index, "FEW", few)
    rules = spark.createDataFrame([("path", "", 3, 1, "/data/*secret*/**", 3, "x"), ("path", "", 3, 2, "*abc*", 2, "y")], RULES)
    frame = spark.createDataFrame([("/data/a",), ("/data/my-secrets/b",), ("xabcx",), ("/data/abc",)], "p string")
    assert {tuple(r) for r in classify_many(frame, "p", rules, HOME).collect()} == {
        ("/data/a", 0, "default"), ("/data/my-secrets/b", 3, "x"), ("xabcx", 2, "y"), ("/data/abc", 0, "default"),
    }


def test_keys():
    assert glob_keys("/a/b") == [("exact", "/a/b")]
    assert glob_keys("/a/**") == [("prefix", "/a"), ("segment", "a")]
    assert glob_keys("**/key.pem") == [("last", "key.pem")]
    assert ("end", "ng-name.") not in glob_keys("**/*-very-long-name.csv") and ("end", "name.csv") in glob_keys("**/*-very-long-name.csv")
    assert glob_keys("/*/?") == [] and glob_keys("**") == [] and glob_keys("*[ab]/x") == []
    assert split_braces("/{a,b{c,d}}/x", 9) == ["/a/x", "/bc/x", "/bd/x"] and split_braces("[{]{", 9) == ["[{]{"]
    assert split_braces("{a,b}" * 9, 64) == ["{a,b}" * 9]


def test_too_many_without_a_literal_part(spark, monkeypatch):
    monkeypatch.setattr(rule_index, "MAX_UNANCHORED", 1)
    rules = spark.createDataFrame([("path", "", 1, 1, "*", 3, "x"), ("path", "", 1, 2, "/?", 3, "x")], RULES)
    with pytest.raises(ValueError):
        classify_many(spark.createDataFrame([("/a",)], "p string"), "p", rules, HOME)

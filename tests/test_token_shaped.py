import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.patterns import patterns_named
from palimpsest.operators.redact import redact, redact_all
from palimpsest.operators.restore import restore, restore_fuzzy
from palimpsest.operators.scopes import redact_scopes
from palimpsest.operators.stored import restore_stored

PATTERNS = patterns_named(("email", "ipv4"))


def _texts():
    rng = random.Random(11)
    atoms = ["[TG:IP:1]", "TG_EMAIL_2", '"TG:IP:4"', "[TG:IP:12345678901]", "a@b.com", "c@d.org", "203.0.113.9", "203.0.113.8", "x", "[TG:OTHER:5]", "TG"]
    return ["", "TG", *(" ".join(rng.choice(atoms) for _ in range(rng.randrange(1, 9))) for _ in range(120))]


@pytest.mark.parametrize("restorer", [restore, restore_fuzzy])
def test_what_looks_like_a_token_comes_back(spark, restorer):
    df = spark.createDataFrame(list(enumerate(_texts())), "id int, text string").withColumn("r", redact("text", PATTERNS))
    twice = df.withColumn("s", redact(F.col("r.text"), patterns_named(("email", "ipv4", "ipv6"))))
    rows = twice.select("text", "r", restorer(F.col("r.text"), F.col("r.tokens"), F.col("r.values")).alias("back"), "s").collect()
    for r in rows:
        assert r["back"] == r["text"]
        assert r["s"]["text"] == r["r"]["text"]
        taken = {c: max(int(n) for k, n in re.findall(r"TG[:_]([A-Z]+)[:_]([0-9]+)", r["text"]) if k == c and len(n) < 10) for c in {k for k, n in re.findall(r"TG[:_]([A-Z]+)[:_]([0-9]+)", r["text"]) if len(n) < 10}}
        numbers = {}
        for t in r["r"]["tokens"]:
            _, c, n = t.strip("[]").split(":")
            numbers.setdefault(c, []).append(int(n))
        assert all(own == list(range(taken.get(c, 0) + 1, taken.get(c, 0) + 1 + len(own))) for c, own in numbers.items())


def test_requests_share_what_is_taken(spark):
    df = spark.createDataFrame([(["a@b.com", "see [TG:EMAIL:7]", None, "c@d.org"],)], "t array<string>")
    (r,) = df.select(redact_all(F.col("t"), F.array(*(F.lit(x) for x in (True, False, True, True))), PATTERNS).alias("r")).collect()
    assert r["r"]["tokens"] == ["[TG:EMAIL:8]", "[TG:EMAIL:9]"]


def test_scopes_share_what_is_taken(spark):
    rows = [(s, i, t) for s in (1, 2) for i, t in enumerate(_texts()[s::2])]
    df = spark.createDataFrame([*rows, (3, 0, "a@b.com")], "scope bigint, seq bigint, text string").repartition(5)
    redacted, mapping = redact_scopes(df, "scope", "seq", "text", PATTERNS)
    literal = {(s, f"[TG:{c}:{n}]") for s, _, t in rows for c, n in re.findall(r"TG[:_]([A-Z]+)[:_]([0-9]+)", t)}
    known = mapping.collect()
    assert known and not {(r["scope"], r["token"]) for r in known} & literal
    assert [r["token"] for r in known if r["scope"] == 3] == ["[TG:EMAIL:1]"]
    texts = redacted.select("scope", "seq", F.col("redacted").alias("text"))
    back = restore_stored(texts, ["scope", "seq"], "text", mapping, ["scope"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))

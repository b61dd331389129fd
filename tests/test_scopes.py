import random

from pyspark.sql import functions as F

from palimpsest.functions.patterns import all_patterns
from palimpsest.operators import scopes
from tests.reference_model import Scope
from tests.test_redact import _random_text


def check(spark, data, patterns):
    """data: scope -> texts in order."""
    rows = [(s, i, t) for s, texts in data.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "scope string, seq bigint, text string").repartition(7)
    redacted, mapping = scopes.redact_scopes(df, "scope", "seq", "text", patterns)
    got = {(r["scope"], r["seq"]): r for r in redacted.collect()}
    tokens = {}
    for r in mapping.collect():
        tokens.setdefault(r["scope"], {})[r["token"]] = r["value"]
        assert r["token"] == f"[TG:{r['category']}:{r['n']}]"
    assert len(got) == len(rows)
    for s, texts in data.items():
        scope = Scope()
        for i, t in enumerate(texts):
            want, n = scope.redact(t, patterns)
            assert got[(s, i)]["redacted"] == want, (s, i, t)
            assert {m["pattern"]: m["n"] for m in got[(s, i)]["matches"]} == n
        plain = {k: scope.restore(v) for k, v in zip(scope.tokens, scope.values)}
        assert tokens.get(s, {}) == plain


def test_scopes_agree_with_going_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(scopes, "STRETCH_ROWS", 3)
    rng = random.Random(4)
    data = {f"s{k}": [_random_text(rng) for _ in range(rng.randrange(1, 12))] for k in range(25)}
    data["none"] = ["nothing", "here"]
    check(spark, data, all_patterns())


def test_one_scope_may_hold_most_rows(spark, monkeypatch):
    monkeypatch.setattr(scopes, "STRETCH_ROWS", 100)
    rng = random.Random(9)
    hot = [f"mail u{rng.randrange(400)}@example.com and hot@example.com from 10.0.{rng.randrange(9)}.{rng.randrange(9)}" for _ in range(1500)]
    from palimpsest.functions.patterns import default_patterns

    check(spark, {"hot": hot, "cold": ["a@b.com", "x"]}, default_patterns())


def test_null_text(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, "a@b.com")], "scope string, seq bigint, text string")
    rows, _ = scopes.redact_scopes(df, "scope", "seq", "text")
    assert {(r["seq"], r["redacted"]) for r in rows.collect()} == {(1, None), (2, "[TG:EMAIL:1]")}
    assert rows.select(F.size("matches")).agg(F.sum("size(matches)")).first()[0] == 1

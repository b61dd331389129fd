import random

import pytest

from palimpsest.functions.literals import literal_trie, prefixes, required_literals
from palimpsest.functions.patterns import custom_pattern, patterns_named
from palimpsest.operators import redact as ops
from palimpsest.operators.redact import redact


@pytest.mark.parametrize(
    ("regex", "want"),
    [
        (r"\bCustomer#(\d+)\b", ("Customer#",)), (r"(?:ghp|gho)_[a-z]{3}", ("gh",)), (r"a(?P<x>bc)+d?ef", ("bc",)), (r"(?i)abcd", ()),
        (r"abc|xyz", ("abc", "xyz")), (r"abc|[0-9]", ()), (r"abc?", ("ab",)), (r"(?:abc)*", ()), (r"(?:abc){2,}x", ("abc",)), (r"app\[[0-9]+\]", ("app",)),
        (r"AKIA[0-9]{4}", ()), (r"TG:EMAIL", ()), (r"[[:digit:]]+-key", ("-key",)), (r"x.y", ()), (r"^foo$", ("foo",)), (r"fo\bo-bar", ("foo-bar",)),
        (r"end\z", ("end",)), (r"(?s)id=(.+?);z", ("id=",)), (r"[", ()), (r"[^[:space:]]{4}-A[[:^digit:]]", ("-A",)), (r"k[[:digit:]]ey", ("ey",)),
    ],
)
def test_required_literals(regex, want):
    assert required_literals(regex) == want


def test_trie_and_prefixes():
    import re

    literals = ["ab", "abc", "abd", "b", "x.y"]
    assert [m.group(1) for m in re.finditer(f"(?=({literal_trie(literals)}))", "abcabdabx.y")] == ["abc", "b", "abd", "b", "ab", "b", "x.y"]
    assert prefixes(literals)["abd"] == ["ab", "abd"]


def test_many_patterns_one_by_one_and_together(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("key", "ke", "tok", "id", "lon") for b in ("", "-", "_", "a", "ab")]
    patterns = patterns_named(("email", "ipv4"))
    for i in range(60):
        w = rng.choice(words)
        patterns.append(custom_pattern(f"p{i}", rng.choice([rf"\b{w}{i}\b", rf"{w}(\d+)x", rf"(?:{w}|zz{i})[0-9]", rf"[0-9]{{2}}{w}?q", rf"(?i){w}{i}z"]), "CUSTOM"[: 1 + i % 6]))
    texts = [" ".join(rng.choice([rng.choice(words) + str(rng.randrange(60)) + rng.choice(["", "x", "q", "Z"]), "a@b.com", "10.0.0.1", f"zz{rng.randrange(60)}7"]) for _ in range(rng.randrange(12))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert sum(p.own_literals and bool(p.needs) for p in patterns) > ops.TOGETHER
    together = df.select("id", redact("text", patterns).alias("r")).orderBy("id").collect()
    monkeypatch.setattr(ops, "candidates", lambda text, patterns: ops.F.sequence(ops.F.lit(1), ops.F.lit(len(patterns))))
    assert df.select("id", redact("text", patterns).alias("r")).orderBy("id").collect() == together

import json

from pyspark.sql import functions as F

from palimpsest.operators.restore import (
    restore,
    restore_event_line,
    restore_exact,
    restore_fuzzy,
    restore_json,
    sanitize_for_log,
    unresolved_tokens,
)
from palimpsest.functions.tokens import has_token, token_category, token_number, tokens_in

MAPPING = {"[TG:IP:1]": "203.0.113.42", "[TG:EMAIL:1]": "admin@example.com", "[TG:DBURL:1]": "pg://[TG:EMAIL:1]/x"}


def run(spark, function, texts, mapping=MAPPING):
    df = spark.createDataFrame(
        [(i, t, list(mapping), list(mapping.values())) for i, t in enumerate(texts)],
        "i int, t string, k array<string>, v array<string>",
    )
    rows = df.select("i", function(F.col("t"), F.col("k"), F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_exact_is_one_pass(spark):
    got = run(spark, restore_exact, ["Check [TG:IP:1] and contact [TG:EMAIL:1]", "[TG:DBURL:1] [TG:IP:9]", "none", None])
    assert got == ["Check 203.0.113.42 and contact admin@example.com", "pg://[TG:EMAIL:1]/x [TG:IP:9]", "none", None]


def test_transitive(spark):
    assert run(spark, restore, ["[TG:DBURL:1] [TG:IP:9]"]) == ["pg://admin@example.com/x [TG:IP:9]"]
    chain = {f"[TG:A:{i}]": f"<[TG:A:{i + 1}]>" for i in range(1, 6)} | {"[TG:A:6]": "end"}
    assert run(spark, restore, ["[TG:A:1]"], chain) == ["<<<<<end>>>>>"]
    assert run(spark, restore, ["[TG:A:1]"], {"[TG:A:1]": "x"}) == ["x"]


def test_a_mapping_that_contains_itself_ends(spark):
    (got,) = run(spark, restore, ["[TG:A:1]"], {"[TG:A:1]": "([TG:A:1])"})
    assert got.count("(") == 11


def test_many_tokens_use_the_search(spark):
    mapping = {f"[TG:IP:{i}]": f"v{i}" for i in range(1, 500)}
    text = " ".join(f"[TG:IP:{i}]" for i in range(1, 520))
    want = " ".join(f"v{i}" if i < 500 else f"[TG:IP:{i}]" for i in range(1, 520))
    assert run(spark, restore_exact, [text], mapping) == [want]
    assert run(spark, lambda t, k, v: F.size(unresolved_tokens(t, k)), [text], mapping) == [20]


def test_fuzzy(spark):
    texts = ['"TG:IP:1"', "`TG:IP:1`", "TG:IP:1", "TG_IP_1", "'TG:EMAIL:1'", "TG:IP:7", "[TG:IP:1]", " TG:IP:1 [TG:IP:1]"]
    want = ["203.0.113.42"] * 4 + ["admin@example.com", "TG:IP:7", "203.0.113.42", " 203.0.113.42 203.0.113.42"]
    assert run(spark, restore_fuzzy, texts) == want
    # the exact phase leaves an inner token, whose inside the fuzzy phase then finds
    assert run(spark, restore_fuzzy, ["[TG:DBURL:1]"]) == ["pg://[admin@example.com]/x"]
    assert run(spark, restore_fuzzy, ["TG:IP:1"], {}) == ["TG:IP:1"]


def test_json(spark):
    body = r'{"[TG:IP:1]":"x \"[TG:IP:1]\" \\","a":[{"b":"\\\" é\n[TG:EMAIL:1]"}], "n" : 1}'
    want = r'{"[TG:IP:1]":"x \"203.0.113.42\" \\","a":[{"b":"\\\" é\nadmin@example.com"}], "n" : 1}'
    assert run(spark, restore_json, [body, "plain [TG:IP:1]", '["[TG:IP:1]"]']) == [want, "plain 203.0.113.42", '["203.0.113.42"]']
    tricky = {"[TG:A:1]": 'q"\\\n'}
    assert run(spark, restore_json, ['{"x":"[TG:A:1]"}'], tricky) == [r'{"x":"q\"\\\n"}']
    fuzzy = lambda t, k, v: restore_json(t, k, v, restore_fuzzy)
    assert run(spark, fuzzy, ['{"x":"TG_IP_1","TG_IP_1":0}']) == ['{"x":"203.0.113.42","TG_IP_1":0}']


def test_event_lines(spark):
    got = run(spark, restore_event_line, ["data: [TG:IP:1]", "event: [TG:IP:1]", "data:", 'data: {"t":"x [TG:IP:1]"}'])
    assert got == ["data: 203.0.113.42", "event: [TG:IP:1]", "data:", 'data: {"t":"x 203.0.113.42"}']


def test_unresolved(spark):
    texts = ["Known [TG:IP:1] and unknown [TG:IP:42] and also [TG:TOKEN:3] [TG:IP:42]", "none"]
    got = run(spark, lambda t, k, v: unresolved_tokens(t, k), texts)
    assert got == [["[TG:IP:42]", "[TG:TOKEN:3]", "[TG:IP:42]"], []]


def test_token_helpers(spark):
    df = spark.createDataFrame([("a [TG:IP:12] b",)], "t string")
    row = df.select(
        has_token(F.col("t")).alias("has"),
        tokens_in(F.col("t")).alias("all"),
        token_category(F.lit("[TG:IP:12]")).alias("c"),
        token_number(F.lit("[TG:IP:12]")).alias("n"),
        sanitize_for_log(F.col("t")).alias("log"),
    ).first()
    assert row["has"] and row["all"] == ["[TG:IP:12]"] and row["c"] == "IP" and row["n"] == 12 and row["log"] == "a [TG:IP:12] b"


def test_equal_tokens_mean_the_first_at_any_size(spark):
    for extra in (0, 30, 40):
        keys = ["[TG:A:1]", "[TG:A:1]"] + [f"[TG:B:{i}]" for i in range(extra)]
        vals = ["zzz", "aaa"] + ["b"] * extra
        df = spark.createDataFrame([("[TG:A:1]", keys, vals)], "t string, k array<string>, v array<string>")
        assert df.select(restore_exact(F.col("t"), F.col("k"), F.col("v"))).first()[0] == "zzz"


def test_deep_nesting_is_undone(spark):
    chain = {"[TG:A:1]": "end"} | {f"[TG:A:{i}]": f"<[TG:A:{i - 1}]>" for i in range(2, 31)}
    assert run(spark, restore, ["[TG:A:30]"], chain) == ["<" * 29 + "end" + ">" * 29]


def test_private_use_characters_change_nothing(spark):
    assert run(spark, restore_fuzzy, ["\ue000 TG_IP_1 \ue001\ue002"]) == ["\ue000 203.0.113.42 \ue001\ue002"]
    body = '{"TG:IP:1": "\ue000\\\\ [TG:A:1] \ue001", "[TG:A:1]"\n: ["\\" [TG:A:1]", 1, {"k": "\\u0041TG"}]}'
    (got,) = run(spark, restore_json, [body], {"[TG:A:1]": 'a"\ue000\n'})
    value = 'a"\ue000\n'
    assert json.loads(got) == {
        "TG:IP:1": f"\ue000\\ {value} \ue001", "[TG:A:1]": [f'" {value}', 1, {"k": "ATG"}]
    }
    assert '"\\u0041TG"' in got
    long = '{"v": "' + "x\\n" * 200_000 + '[TG:A:1]"}'
    assert run(spark, restore_json, [long], {"[TG:A:1]": "z"})[0].endswith('z"}')


def test_a_category_is_looked_for_only_where_it_is_spelled(spark):
    mapping = {"[TG:IP:1]": "TG_IPX_1", "[TG:IPX:1]": "x", "[TG:EMAIL:1]": "TG:IP:1"}
    texts = ["\"TG:IP:1\" and 'TG:IP:2", "see `TG_EMAIL_1`", "TGIP:1 [TG:EMAIL_1", "TG:IPX_1,TG_IP:1"]
    assert run(spark, restore_fuzzy, texts, mapping) == ["x and 'TG:IP:2", "see x", "TGIP:1 [x", "x,x"]
    found = restore_fuzzy(F.col("t"), F.col("k"), F.col("v"))
    plan = spark.createDataFrame([("a", ["[TG:IP:1]"], ["v"])], "t string, k array<string>, v array<string>").select(found)
    assert "contains(" in plan._jdf.queryExecution().analyzed().toString().lower()


def test_texts_are_split_as_by_the_regex(spark):
    from palimpsest.functions.expr import split_at
    from palimpsest.functions.tokens import TOKEN_REGEX

    texts = [None, "", "a", "[TG:A:1]", "[TG:A:1][TG:B:2]", "x[TG:A:1]\n", "\ue004", "\ue004[TG:A:1] \ue004", "[TG:A:1", "é[TG:A:1]$1\\"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = rows.select(split_at(F.col("t"), TOKEN_REGEX).alias("a"), F.split("t", TOKEN_REGEX, -1).alias("b"))
    assert all(r["a"] == r["b"] for r in pairs.collect())
    # only a text that has the mark already is split by the regex, which is compiled for each text
    plan = rows.select(split_at(F.col("t"), TOKEN_REGEX))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan

import uuid

from pyspark.sql import functions as F

from palimpsest.functions.expr import lookup_table
from palimpsest.functions.patterns import all_patterns
from palimpsest.operators import report
from palimpsest.operators.restore import categories_of, restore, restore_exact, restore_fuzzy
from palimpsest.operators.stored import restore_stored
from palimpsest.plans import gateway
from palimpsest.plans.corpus import redact_corpus
from palimpsest.plans.presets import load_rules
from palimpsest.session import Workspace
from palimpsest.sources.requests import malformed_count, read_requests
from tests.test_gateway import requests


def restored(spark, texts, mapping, key=("k",), scope=None):
    schema = "s string, k int, text string"
    df = spark.createDataFrame(texts, schema).select(*key, "text")
    return {r[-2]: r[-1] for r in restore_stored(df, list(key), "text", mapping, scope).collect()}


def test_stored_corpus_comes_back(spark, tmp_path):
    texts = ["a@b.com, postgres://u:p@db.lan:5432/x and a@b.com", "nothing", "", None, "ip 203.0.113.9 a@b.com", "[TG:IP:7] stays"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "c@d.com")], "k int, text string").repartition(3)
    corpus = redact_corpus(df, "text", ["k"], all_patterns())
    corpus.select("k", F.col("redacted.text").alias("text")).write.parquet(str(tmp_path / "t"))
    report.mapping_rows(corpus, ["k"]).write.parquet(str(tmp_path / "m"))
    got = restore_stored(spark.read.parquet(str(tmp_path / "t")), ["k"], "text", spark.read.parquet(str(tmp_path / "m")))
    assert {r["k"]: r["text"] for r in got.collect()} == dict(enumerate(texts)) | {None: "c@d.com"}


def test_nesting_has_no_depth_limit_and_no_cycles(spark):
    chain = [(1, n, f"[TG:X:{n + 1}]", f"<[TG:X:{n}]{n}>" if n else "v") for n in range(40)]
    chain += [(2, 0, "[TG:X:1]", "a[TG:X:2]"), (2, 1, "[TG:X:2]", "b[TG:X:1]"), (2, 2, "[TG:X:3]", "[TG:X:3]")]
    mapping = spark.createDataFrame(chain, "k int, ord int, token string, value string")
    got = restored(spark, [("", 1, "x [TG:X:40] y"), ("", 2, "[TG:X:2] [TG:X:3]"), ("", 3, "[TG:X:1]")], mapping)
    want = "v"
    for n in range(1, 40):
        want = f"<{want}{n}>"
    assert got == {1: f"x {want} y", 2: "ba[TG:X:2] [TG:X:3]", 3: "[TG:X:1]"}


def test_a_token_may_fill_a_scope(spark):
    mapping = spark.createDataFrame([("hot", "[TG:X:1]", "v"), ("cold", "[TG:X:1]", "w")], "s string, token string, value string")
    texts = [("hot", i, f"{i} [TG:X:1] [TG:X:2] [TG:X:1]") for i in range(500)] + [("cold", 500, "[TG:X:1]")]
    got = restored(spark, texts, mapping, ("s", "k"), ["s"])
    assert got == {i: f"{i} v [TG:X:2] v" for i in range(500)} | {500: "w"}


def test_a_given_lookup_table_changes_nothing(spark):
    for n in (0, 3, 32, 33, 200):
        tokens = [f"[TG:IP:{i}]" for i in range(n)] + ["[TG:IP:1]"] * (n > 0)
        values = [f"v{i}" for i in range(n)] + ["late"] * (n > 0)
        one = spark.createDataFrame([("x [TG:IP:1] TG_IP_2 `TG:IP:32`[TG:IP:9999]", tokens, values)], "t string, k array<string>, v array<string>")
        t, k, v = F.col("t"), F.col("k"), F.col("v")
        for f, more in ((restore, ()), (restore_exact, ()), (restore_fuzzy, (categories_of(k),))):
            row = one.select(f(t, k, v).alias("a"), f(t, k, v, lookup_table(k, v), *more).alias("b")).first()
            assert row["a"] == row["b"], (n, f)


def test_a_model_is_asked_once_and_all_outputs_agree(spark):
    calls = spark.sparkContext.accumulator(0)

    def answer(texts):
        calls.add(len(texts))
        return texts.map(lambda t: f"{uuid.uuid4().hex}@example.com")

    body = '{"messages":[{"role":"user","content":"see /var/log/x and ~/.ssh/id_rsa"},{"role":"tool","content":"cmd: mysql -u root"}]}'
    from palimpsest.operators.rules import Config

    rules = load_rules("server", user=Config(local_only=("/var/log/x", "~/.ssh/id_rsa"), commands=(("mysql *", "local-only"),)), home="/home/u")
    with Workspace(spark) as space:
        done = gateway.process_requests(requests(spark, [body]), rules, answer, space=space)
        bodies = done.select("new_body").first()[0]
        mapping = gateway.mappings(done).first()
        blocks = [r["new_content"] for r in gateway.block_rows(done).filter("summarized").collect()]
        gateway.audit_entries(done).collect()
        assert blocks and calls.value == len(blocks)
        assert all(any(t in b for t in mapping["tokens"]) for b in blocks) and all(b in bodies for b in blocks)
        assert gateway.mappings(done).first()["values"] == mapping["values"]


def test_landed_requests(spark, tmp_path):
    lines = [
        '{"request_id":"1","ts":"2024-01-01T00:00:00Z","path":"/openai/v1","headers":{"USER-agent":"aider 1","x-agent":"t"},"body":"{}"}',
        '{"request_id":"2","path":"/openai/v1","body":"no json"}',
        '{"request_id":',
        "[1]",
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(lines) + "\n")
    df = read_requests(spark, str(tmp_path / "r.jsonl"))
    got = {r["request_id"]: (r["agent_header"], r["user_agent"], r["body"]) for r in df.collect() if r["request_id"]}
    assert got == {"1": ("t", "aider 1", "{}"), "2": (None, None, "no json")}
    assert tuple(malformed_count(df).first()) == (4, 2)
    assert gateway.rejected(df).count() == 2
    stream = read_requests(spark, str(tmp_path), stream=True)
    assert stream.isStreaming and stream.columns == df.columns

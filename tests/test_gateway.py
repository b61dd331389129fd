import datetime as dt
import json

from pyspark.sql import functions as F

from palimpsest.operators.requests import parse_blocks, rebuild_body
from palimpsest.operators.restore import restore_fuzzy
from palimpsest.operators.rules import USER, Config, assemble
from palimpsest.operators.traffic import detect_agent, resolve_provider, upstream_host, upstream_path
from palimpsest.plans import gateway
from palimpsest.plans.presets import load_rules

TS = dt.datetime(2024, 1, 1)


def blocks_of(spark, bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    return [r["b"] for r in df.select("i", parse_blocks(F.col("body")).alias("b")).orderBy("i").collect()]


def requests(spark, bodies, path="/anthropic/v1/messages"):
    return spark.createDataFrame(
        [(f"r{i}", TS, None, "claude-code/1", path, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)],
        "request_id string, ts timestamp, agent_header string, user_agent string, path string, body string",
    )


def message(content, role="user", **more):
    return {"role": role, "content": content, **more}


def processed(spark, bodies, rules=None, summarize=None):
    rows = gateway.process_requests(requests(spark, bodies), rules or load_rules("server", home="/home/u"), summarize)
    return {r["request_id"]: r for r in rows.collect()}


def test_parse(spark):
    body = json.dumps(
        {
            "messages": [
                message("hi\n  File: /etc/x : y \npath: /other"),
                "not an object",
                message([{"type": "text", "text": "a"}, {"content": "CMD: ls"}, 3, {"text": 5}], "assistant", tool_calls=None),
                message("cmd:\ncommand: late", "tool", tool_call_id="t1"),
                message("x", "tool", tool_call_id=""),
                message("x", "user", tool_calls=[]),
                {"role": 7, "content": None},
                message("be nice", "system"),
            ]
        }
    )
    (got, *empty) = blocks_of(spark, [body, "not json", '{"messages":[]}', "[1]", '{"messages":"x"}', "{}"])
    assert empty == [[], [], [], [], []]
    seen = [(b["is_object"], b["role"], b["content"], b["file_path"], b["command"], b["is_tool_result"], b["is_system"]) for b in got]
    assert seen[0] == (True, "user", "hi\n  File: /etc/x : y \npath: /other", "/etc/x : y", "", False, False)
    assert seen[1][0] is False
    assert seen[2] == (True, "assistant", "a\nCMD: ls\n", "", "ls", True, False)
    # the first such line counts, even if nothing follows
    assert seen[3] == (True, "tool", "cmd:\ncommand: late", "", "", True, False)
    assert [s[5] for s in seen[4:]] == [False, False, False, False]
    assert seen[6][1:3] == ("", "") and seen[7][6] is True


def test_rebuild_keeps_everything_else(spark):
    body = json.dumps({"z": [1, {"a": None}], "messages": [message("a", x={"b": 1.5}), 5, {"role": "user"}], "m": "é"})
    df = spark.createDataFrame([(body,)], "body string")
    new = df.select(rebuild_body(F.col("body"), F.array(F.lit('new "q"\n'), F.lit(None), F.lit("c")))).first()[0]
    assert json.loads(new) == {
        "z": [1, {"a": None}], "messages": [message('new "q"\n', x={"b": 1.5}), 5, message("c")], "m": "é",
    }
    assert df.select(rebuild_body(F.col("body"), F.array(F.lit(None).cast("string")))).first()[0] == body


def test_each_tier(spark):
    got = processed(
        spark,
        [
            {"messages": [message("plain 203.0.113.42")]},
            {"messages": [message("Check /var/log/x with IP 203.0.113.42")]},
            {"messages": [message("see /etc/nginx/sites-enabled/a 203.0.113.42"), message("again ~/.ssh/id_x"), message("from /etc/crontab: 203.0.113.42, 10.0.0.1")]},
            "not json",
            {"messages": []},
        ],
    )
    content = lambda r, i: json.loads(got[r]["new_body"])["messages"][i]["content"]
    assert content("r0", 0) == "plain 203.0.113.42" and not got["r0"]["blocked"]
    assert content("r1", 0) == gateway.LOCAL_MISSING
    assert content("r2", 0) == "see /etc/nginx/sites-enabled/a [TG:IP:1]"
    assert content("r2", 1) == gateway.DENIED and got["r2"]["blocked"]
    assert content("r2", 2) == "from /etc/crontab: [TG:IP:1], [TG:IP:2]"
    assert got["r2"]["values"] == ["203.0.113.42", "10.0.0.1"]
    assert got["r3"]["new_body"] == "not json" and got["r4"]["new_body"] == '{"messages": []}'
    assert got["r3"]["blocks"] == [] and not got["r3"]["blocked"]


def test_summaries_share_the_requests_scope(spark):
    def shout(texts):
        return texts.map(lambda t: None if "fail" in t else "SUM " + t)

    got = processed(
        spark,
        [
            {"messages": [message("/etc/crontab 10.0.0.1"), message("/var/log/x 10.0.0.2 10.0.0.1"), message("/var/log/y fail")]},
            {"messages": [message("nothing")]},
            "no json",
        ],
        summarize=shout,
    )
    new = [m["content"] for m in json.loads(got["r0"]["new_body"])["messages"]]
    assert new == ["/etc/crontab [TG:IP:1]", "[Local summary: SUM /var/log/x [TG:IP:2] [TG:IP:1]]", gateway.LOCAL_FAILED]
    assert got["r0"]["values"] == ["10.0.0.1", "10.0.0.2"]
    assert json.loads(got["r1"]["new_body"])["messages"][0]["content"] == "nothing"


def test_toggles_reach_the_redactor(spark):
    rules = assemble([(USER, "user", Config(redact=("/x",), patterns={"ipv4": False, "ipv4_private": False}))], "/home/u")
    got = processed(spark, [{"messages": [message("/x 10.0.0.1 a@b.com")]}], rules)
    assert json.loads(got["r0"]["new_body"])["messages"][0]["content"] == "/x 10.0.0.1 [TG:EMAIL:1]"


def test_array_content_keeps_both_kinds_of_parts(spark):
    parts = [{"type": "text", "text": "path: /etc/crontab"}, {"type": "tool_result", "content": "10.0.0.1"}]
    got = processed(spark, [{"messages": [message(parts)]}])
    assert json.loads(got["r0"]["new_body"])["messages"][0]["content"] == "path: /etc/crontab\n[TG:IP:1]\n"


def test_audit_entries(spark):
    rows = gateway.process_requests(
        requests(spark, [{"messages": [message("/etc/crontab 10.0.0.1 a@b.com 10.0.0.1"), message("x"), message("~/.ssh/id_a"), message("/var/log/z"), message("/etc/crontab")]}]),
        load_rules("server", home="/home/u"),
    )
    got = [(r["tier"], r["redactions"], r["notes"]) for r in gateway.audit_entries(rows).orderBy("id").collect()]
    assert got == [
        ("redacted", '{"email":1,"ipv4_private":2}', None),
        ("public", None, None),
        ("blocked", None, "blocked by rule: pattern"),
        ("blocked", None, "local model unavailable"),
        ("redacted", "{}", None),
    ]
    assert gateway.total_matches(rows).first()["matches"] == 3


def test_responses_use_their_own_mapping(spark):
    rows = gateway.process_requests(
        requests(spark, [{"messages": [message("/etc/crontab 10.0.0.1")]}, {"messages": [message("/etc/crontab 10.0.0.2")]}, {"messages": [message("x")]}]),
        load_rules("server", home="/home/u"),
    )
    answers = spark.createDataFrame([(f"r{i}", '{"t":"it is [TG:IP:1] or TG_IP_1"}') for i in range(4)], "request_id string, body string")
    mapping = gateway.mappings(rows)
    got = {r["request_id"]: json.loads(r["body"])["t"] for r in gateway.restore_responses(answers, mapping).collect()}
    assert got == {
        "r0": "it is 10.0.0.1 or TG_IP_1", "r1": "it is 10.0.0.2 or TG_IP_1",
        "r2": "it is [TG:IP:1] or TG_IP_1", "r3": "it is [TG:IP:1] or TG_IP_1",
    }
    fuzzy = {r["request_id"]: json.loads(r["body"])["t"] for r in gateway.restore_responses(answers, mapping, restore_fuzzy).collect()}
    assert fuzzy["r1"] == "it is 10.0.0.2 or 10.0.0.2"


def test_length_that_parts_unknown_clients(spark):
    rows = spark.createDataFrame([("x" * 40 + "a",), ("x" * 40 + "b",)], "u string")
    agents = lambda **more: {r[0] for r in rows.select(detect_agent(F.lit(None), F.col("u"), **more)).collect()}
    assert agents() == {"ua:" + "x" * 40} and agents(length=50) == {"ua:" + "x" * 40 + c for c in "ab"}


def test_agents_and_providers(spark):
    cases = [
        (None, "claude-code/1.0.28", "claude-code"), (None, "Hermes-Agent/0.19.0", "hermes"), ("", "aider 0.8.0", "aider"),
        (None, "some-random-tool/1.0", "ua:some-random-tool/1.0"), (None, "", "unknown"), (None, None, "unknown"),
        ("mine", "codex", "mine"), (None, "x" * 50, "ua:" + "x" * 40), (None, "GH Copilot cursor", "cursor"),
    ]
    df = spark.createDataFrame([(i, h, u) for i, (h, u, _) in enumerate(cases)], "i int, h string, u string")
    got = df.select("i", detect_agent(F.col("h"), F.col("u")).alias("a")).orderBy("i").collect()
    assert [r["a"] for r in got] == [w for _, _, w in cases]

    paths = [("/anthropic", "anthropic", ""), ("/anthropic/v1?", "anthropic", "/v1?"), ("/anthropicevil/v1", None, None), ("/xai/", "xai", "/"), ("x/openai/", None, None)]
    df = spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(paths)], "i int, p string")
    provider = resolve_provider(F.col("p"))
    got = df.select("i", provider.alias("n"), upstream_path(F.col("p"), F.lit("")).alias("u"), upstream_host(provider).alias("h")).orderBy("i").collect()
    assert [(r["n"], r["u"]) for r in got] == [(n, u) for _, n, u in paths]
    assert got[0]["h"] == "api.anthropic.com" and got[2]["h"] is None
    assert df.select(upstream_path(F.lit("/openai/v1"), F.lit("a=b"))).first()[0] == "/v1?a=b"


def test_unknown_providers_are_rejected(spark):
    rows = requests(spark, ['{"messages":[]}'], "/other/v1")
    assert gateway.process_requests(rows, load_rules("server")).count() == 0
    assert gateway.rejected(rows).count() == 1

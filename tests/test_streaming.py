import random
import re

from pyspark.sql import functions as F

from palimpsest.operators.restore import restore, restore_fuzzy
from palimpsest.streaming import chunks as ops
from palimpsest.streaming.streams import run_available, stream_table

SCHEMA = ops.CHUNK_SCHEMA
MAPPING = [("r", ["[TG:IP:1]", "[TG:EMAIL:1]"], ["203.0.113.42", "a@b.com"])]


def chunk_rows(response, parts, ended=True):
    return [(response, i, p, ended and i == len(parts) - 1) for i, p in enumerate(parts)]


def mapping(spark, rows=MAPPING):
    return spark.createDataFrame(rows, "request_id string, tokens array<string>, values array<string>")


def by_seq(rows):
    return [(r["seq"], r["text"]) for r in sorted(rows, key=lambda r: r["seq"])]


def streamed(spark, tmp_path, batches, restorer=restore_fuzzy):
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream_table(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1)
        out = ops.restore_chunks(ops.realign_stream(stream), mapping(spark), restorer)
        run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_split_token_over_batches(spark, tmp_path):
    first, second = chunk_rows("r", ["The IP is [TG:IP:", "1] confirmed"], ended=False)
    got = by_seq(streamed(spark, tmp_path, [[first], [second]]))
    assert got == [(0, "The IP is "), (1, "203.0.113.42 confirmed")]


def test_end_releases_what_is_held(spark, tmp_path):
    batches = [chunk_rows("r", ["IP is [TG:IP:"], ended=False), [("r", 1, "", True)]]
    assert by_seq(streamed(spark, tmp_path, batches)) == [(0, "IP is "), (1, "[TG:IP:")]


def test_brackets_are_no_tokens(spark, tmp_path):
    got = by_seq(streamed(spark, tmp_path, [chunk_rows("r", ["array[0] = [TG:IP:1]", " value[1]"])]))
    assert got == [(0, "array[0] = 203.0.113.42"), (1, " value[1]")]


def test_too_long_for_a_token_is_not_held(spark, tmp_path):
    long = "x [TG:" + "A" * 80
    assert by_seq(streamed(spark, tmp_path, [chunk_rows("r", [long, "B"], ended=False)])) == [(0, long), (1, "B")]


def _random_responses(rng, n):
    atoms = ["[TG:IP:1]", "[TG:EMAIL:1]", "[TG:IP:9]", "[", "[T", "x", " ", "[TG:", "]", "é", "[TG:IP:1", "ab"]
    rows, texts = [], {}
    for r in range(n):
        text = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 40)))
        parts, at = [], 0
        while at < len(text):
            size = rng.choice([1, 1, 2, 3, 8, 30])
            parts.append(text[at:at + size])
            at += size
        rows += chunk_rows(f"r{r}", parts)
        texts[f"r{r}"] = text
    return rows, texts


def _joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        out[r["response_id"]] = out.get(r["response_id"], "") + r["text"]
    return out


def _whole(texts):
    return {k: t.replace("[TG:IP:1]", "203.0.113.42").replace("[TG:EMAIL:1]", "a@b.com") for k, t in texts.items()}


def test_random_chunks_batch(spark, monkeypatch):
    monkeypatch.setattr(ops, "STRETCH_CHUNKS", 70)  # several stretches per response
    rows, texts = _random_responses(random.Random(1), 60)
    long = ["[TG", ":IP:", "1", "] "] * 100
    rows += chunk_rows("long", long)
    texts["long"] = "".join(long)
    rows += [("cut", 0, "a [TG:IP:", False), ("end", 0, "b [TG:IP:", False), ("end", 1, "", True)]
    rows += [("edge", i, c, False) for i, c in enumerate("x" * 66 + "[TG:IP:1]" + "y" * 66)]
    texts |= {"cut": "a [TG:IP:", "end": "b [TG:IP:", "edge": "x" * 66 + "[TG:IP:1]" + "y" * 66}
    names = [(k, *MAPPING[0][1:]) for k in texts]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = ops.restore_chunks(ops.realign(df), mapping(spark, names), restore).collect()
    assert _joined(got) == _whole(texts)


def test_random_chunks_stream(spark, tmp_path):
    rows, texts = _random_responses(random.Random(2), 25)
    names = [(k, *MAPPING[0][1:]) for k in texts]
    batches = [[r for r in rows if r[1] < 4], [r for r in rows if r[1] >= 4]]
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream_table(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1)
        run_available(ops.restore_chunks(ops.realign_stream(stream), mapping(spark, names), restore), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert _joined(spark.read.parquet(str(tmp_path / "out")).collect()) == _whole(texts)


def test_empty_chunks_and_gaps_lose_nothing(spark):
    rows = [("r", 0, "x [TG:I", False), *[("r", i, "", False) for i in range(1, 71)], ("r", 71, "P:1] y", True)]
    rows += [("g", 4095, "x [TG:I", False), ("g", 4097, "P:1", False), ("g", 90_000, "] y", False)]
    rows += [(None, 5, "n [T", False), (None, 9, "G:IP:1]", False), ("s", 1, None, False), ("s", None, "q", False)]
    names = [(k, *MAPPING[0][1:]) for k in ("r", "g")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in sorted(ops.restore_chunks(ops.realign(df), mapping(spark, names), restore).collect(), key=lambda r: r["seq"] or 0):
        got[r["response_id"]] = got.get(r["response_id"], "") + r["text"]
    assert got == {"r": "x 203.0.113.42 y", "g": "x 203.0.113.42 y", None: "n [TG:IP:1]", "s": "q"}


def test_spellings_split_at_every_place(spark):
    tokens, values = [f"[TG:IP:{i}]" for i in (1, 12)], ["10.0.0.1", "10.9.9.9"]
    texts = ["a TG_IP_12 b", '"TG:IP:1""TG_IP_12"', "`TG_IP_1` [TG:IP:12]", 'TG_IP_9"TG_IP_12 x', "T TG T[", "[TG_IP_12", "TG_IP_1"]
    rows, whole = [], {}
    for n, text in enumerate(texts):
        for cut in range(1, len(text)):
            rows += [(f"{n}-{cut}", 0, text[:cut], False), (f"{n}-{cut}", 1, text[cut:], False)]
        rows += [(f"{n}-c", i, c, False) for i, c in enumerate(text)]
    one = spark.createDataFrame([(n, t, tokens, values) for n, t in enumerate(texts)], "n int, t string, k array<string>, v array<string>")
    for r in one.select("n", restore_fuzzy(F.col("t"), F.col("k"), F.col("v")).alias("t")).collect():
        whole[r["n"]] = r["t"]
    names = [(k, tokens, values) for k in {r[0] for r in rows}]
    got = _joined(ops.restore_chunks(ops.realign(spark.createDataFrame(rows, SCHEMA)), mapping(spark, names)).collect())
    assert got == {k: whole[int(k.split("-")[0])] for k in got} and len(got) == len(names)


def test_late_chunks_pass_and_nothing_held_is_lost(spark, tmp_path):
    batches = [[("r", 0, "a ", False), ("r", 2, "b [TG:I", False)], [("r", 1, "late ", False)], [("r", 3, "P:1] c", True), ("r", 4, "T", False)]]
    got = by_seq(streamed(spark, tmp_path, batches))
    assert got == [(0, "a "), (1, "late "), (2, "b "), (3, "203.0.113.42 c")]  # the T is held until more comes or time is up


def test_without_mapping_nothing_changes(spark):
    df = spark.createDataFrame(chunk_rows("other", ["a [TG:I", "P:1] b"]), SCHEMA)
    got = ops.restore_chunks(ops.realign(df), mapping(spark)).collect()
    assert _joined(got) == {"other": "a [TG:IP:1] b"}


def test_idle_responses_are_released(spark, tmp_path):
    spark.createDataFrame(chunk_rows("r", ["x [TG:"], ended=False), SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = stream_table(spark, str(tmp_path / "in"), SCHEMA)
    query = (
        ops.realign_stream(stream, idle_ms=300).writeStream.format("memory").queryName("idle").trigger(processingTime="300 milliseconds").start()
    )
    try:
        for _ in range(40):
            rows = spark.table("idle").select("seq", "text").collect()
            if len(rows) == 2:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert [r["text"] for r in rows] == ["x ", "[TG:"]


def test_redaction_runs_on_streams(spark, tmp_path):
    from palimpsest.operators.redact import redact

    spark.createDataFrame([(1, "a@b.com")], "id int, text string").write.parquet(str(tmp_path / "in"))
    stream = stream_table(spark, str(tmp_path / "in"), "id int, text string")
    run_available(stream.select("id", redact("text")["text"].alias("t")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).select(F.col("t")).first()[0] == "[TG:EMAIL:1]"


def test_only_runs_that_can_be_held_are_looked_back_over(spark):
    chunks = spark.createDataFrame(chunk_rows("r", ["The IP is [TG:IP:", "1", "] and ", "[T"], ended=False), SCHEMA)
    plan = ops.realign(chunks)._jdf.queryExecution().optimizedPlan().toString()
    back = [line for line in plan.splitlines() if "collect_list" in line and "Window" in line]
    assert back and all("together" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in back)
    assert by_seq(ops.realign(chunks).collect()) == [(0, "The IP is "), (2, "[TG:IP:1] and "), (3, "[T")]


def test_realigned_batch_is_the_stream_at_every_run_length(spark):
    text = "[TG:IP:1]" + "A" * 70 + '"TG_IP_1" ' + "`TG:EMAIL:12" + " é[" + "T" * 66 + "[TG:A" + "1" * 5
    rows = [r for size in (1, 2, 3, 7, 63, 64, 65) for r in chunk_rows(f"r{size}", [text[i : i + size] for i in range(0, len(text), size)], False)]
    got = {}
    for r in ops.realign(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["response_id"], []).append((r["seq"], r["text"]))
    for response, pieces in got.items():
        held, want = "", []
        own = [r for r in rows if r[0] == response]
        for _, seq, chunk, _ in own:
            whole = held + chunk
            last = seq == own[-1][1]
            held = "" if last else re.search(ops.TAIL_REGEX + r"\Z", whole[-ops.MAX_TAIL :]).group()
            if whole[: len(whole) - len(held)]:
                want.append((seq, whole[: len(whole) - len(held)]))
        assert sorted(pieces) == want, response

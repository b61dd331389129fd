import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.patterns import all_patterns, patterns_named
from palimpsest.operators.restore import restore, restore_fuzzy
from palimpsest.operators.scopes import redact_scopes
from palimpsest.streaming import responses as ops
from palimpsest.streaming.scopes import redact_scopes_stream, run_scopes, stream_mapping
from palimpsest.streaming.streams import stream_table
from tests.test_redact import _random_text

TURNS = "scope string, seq bigint, text string"
START = dt.datetime(2024, 1, 1)


def _append(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


@pytest.mark.parametrize("split", [1, 3])
def test_scopes_go_on_over_batches_and_restarts(spark, tmp_path, split):
    rng = random.Random(split)
    rows = [(f"s{k}", i, _random_text(rng)) for k in range(8) for i in range(rng.randrange(1, 9))]
    rows += [("s0", 100 + i, t) for i, t in enumerate(["none", None, "a@b.com [TG:EMAIL:1]", "z@y.org"])]
    rows += [(None, 0, "a@b.com"), (None, 1, "a@b.com c@d.com")]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [[r for r in rows if r[1] % 100 % split == j] for j in range(split)] if split == 1 else [
        [r for r in rows if r[1] < 2], [r for r in rows if 2 <= r[1] < 5], [r for r in rows if r[1] >= 5]]
    patterns = [p for p in all_patterns()]
    # A token-shaped text of a later batch is not known when numbers are handed out before.
    rows = [r for r in rows if not (split > 1 and r[2] and "TG" in r[2])]
    for batch in batches:
        _append(spark, [r for r in batch if r in rows], TURNS, tmp_path / "in")
        stream = stream_table(spark, str(tmp_path / "in"), TURNS, files_per_batch=1)
        run_scopes(redact_scopes_stream(stream, "scope", "seq", "text", patterns), out, checkpoint)
    whole = spark.read.parquet(out)
    none = whole.filter("scope IS NULL").orderBy("seq").collect()
    assert [r["redacted"] for r in none] == ["[TG:EMAIL:1]", "[TG:EMAIL:1] [TG:EMAIL:2]"] and whole.count() == len(rows)
    got, rows = whole.filter("scope IS NOT NULL"), [r for r in rows if r[0] is not None]
    want, mapping = redact_scopes(spark.createDataFrame([r for r in rows if r[2] is not None], TURNS), "scope", "seq", "text", patterns)
    as_rows = lambda df: sorted(((r["scope"], r["seq"], r["redacted"], sorted(map(tuple, r["matches"]))) for r in df.collect()), key=repr)
    assert as_rows(got.filter("redacted IS NOT NULL")) == as_rows(want)
    assert sorted(map(tuple, stream_mapping(got, "scope").collect()), key=repr) == sorted(map(tuple, mapping.collect()), key=repr)


def _at(seconds):
    return START + dt.timedelta(seconds=seconds)


class _Runs:
    """Runs over what is there, one after the other, of one stream of responses."""

    def __init__(self, spark, folder, restorer=restore_fuzzy, files=1):
        self.spark, self.folder, self.restorer, self.files = spark, folder, restorer, files
        for name, schema in (("chunks", ops.CHUNKS), ("mappings", ops.MAPPINGS), ("clock", ops.CLOCK)):
            spark.createDataFrame([], schema).write.parquet(str(folder / name))

    def __call__(self, chunks=(), mappings=(), at=0):
        for name, schema, rows in (("chunks", ops.CHUNKS, chunks), ("mappings", ops.MAPPINGS, mappings)):
            if rows:
                _append(self.spark, rows, schema, self.folder / name)
        read = lambda name, schema: stream_table(self.spark, str(self.folder / name), schema, self.files)
        out = ops.restore_responses_stream(read("chunks", ops.CHUNKS), read("mappings", ops.MAPPINGS), read("clock", ops.CLOCK), restorer=self.restorer)
        ops.run_responses(out, str(self.folder / "out"), str(self.folder / "cp"), str(self.folder / "clock"), _at(at))
        rows = self.spark.read.schema(ops.RESTORED).parquet(str(self.folder / "out")).collect()
        ordered = sorted((r["response_id"] or "", r["seq"], r["part"], r["text"]) for r in rows)
        return [(r[0], r[1], r[3]) for r in ordered]


MAPPING = ("r", ["[TG:IP:1]", "[TG:EMAIL:1]"], ["203.0.113.42", "a@b.com"])


def test_mapping_after_chunks_and_the_other_way(spark, tmp_path):
    run = _Runs(spark, tmp_path)
    chunks = [("r", 0, "plain ", False, _at(0)), ("r", 1, "ip [TG:I", False, _at(1)), ("r", 2, "P:1] and TG_EMAIL_1", False, _at(2))]
    assert run(chunks, at=3) == [("r", 0, "plain "), ("r", 1, "ip ")]
    before = run(mappings=[(*MAPPING, _at(4)), ("q", ["[TG:IP:1]"], ["10.0.0.9"], _at(4))], at=5)
    assert before == [("r", 0, "plain "), ("r", 1, "ip "), ("r", 2, "203.0.113.42 and ")]
    after = run([("r", 3, ".", True, _at(6)), ("q", 0, "to [TG:IP:1]", True, _at(6))], at=7)
    assert [r for r in after if r not in before] == [("q", 0, "to 10.0.0.9"), ("r", 3, "a@b.com.")]
    assert run(at=5000) == after


def test_broken_off_is_released_in_the_same_run(spark, tmp_path):
    run = _Runs(spark, tmp_path)
    rows = [("r", 0, "a [TG:IP:1] b [TG:I", False, _at(0)), ("none", 0, "x [TG:IP:1] y [", False, _at(0)), (None, 0, "[TG:", False, _at(0))]
    got = run(rows, [(*MAPPING, _at(0))], at=700)
    assert got == [("", 0, "[TG:"), ("none", 0, "x [TG:IP:1] y "), ("none", 0, "["), ("r", 0, "a 203.0.113.42 b "), ("r", 0, "[TG:I")]
    # What comes after that is a new response, without its mapping; it is not lost for being late.
    assert [r for r in run([("r", 1, "P:1] late", True, _at(10))], at=1400) if r not in got] == [("r", 1, "P:1] late")]


def test_a_response_that_goes_on_is_not_silent(spark, tmp_path):
    run = _Runs(spark, tmp_path)
    run([("r", 0, "a [TG:", False, _at(0))], [(*MAPPING, _at(0))], at=500)
    assert run([("r", 1, "IP:1", False, _at(500))], at=900) == [("r", 0, "a ")]
    assert run([("r", 2, "] b", False, _at(1000))], at=1100) == [("r", 0, "a "), ("r", 2, "203.0.113.42 b")]


def test_values_in_values(spark, tmp_path):
    run = _Runs(spark, tmp_path, restore)
    nested = ("r", ["[TG:EMAIL:1]", "[TG:URL:1]", "[TG:URL:2]"], ["a@b.com", "http://[TG:EMAIL:1]/", "<[TG:URL:1]>"], _at(0))
    assert run([("r", 0, "see [TG:URL:2] [TG:URL:9]", True, _at(0))], [nested], at=1) == [("r", 0, "see <http://a@b.com/> [TG:URL:9]")]


def test_random_arrival(spark, tmp_path):
    rng = random.Random(6)
    atoms = ["[TG:IP:1]", "[TG:EMAIL:1]", "[TG:IP:9]", "[", "[T", "x", " ", "[TG:", "]", "é", "ab"]
    texts, chunks = {}, []
    for k in range(12):
        text = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 30)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(4, len(text))))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        texts[f"r{k}"] = text
        chunks.append([(f"r{k}", i, p, k % 2 == 0 and i == len(parts) - 1, _at(i)) for i, p in enumerate(parts)])
    run = _Runs(spark, tmp_path, restore)
    late = rng.sample(range(12), 6)
    mapping = lambda k: (f"r{k}", *MAPPING[1:], _at(0))
    run([c for own in chunks for c in own if c[1] < 2], [mapping(k) for k in range(12) if k not in late], at=3)
    run([c for own in chunks for c in own if c[1] == 2], at=4)
    got = run([c for own in chunks for c in own if c[1] > 2], [mapping(k) for k in late], at=5000)
    whole = {}
    for r, _, text in got:
        whole[r] = whole.get(r, "") + text
    assert whole == {k: t.replace("[TG:IP:1]", "203.0.113.42").replace("[TG:EMAIL:1]", "a@b.com") for k, t in texts.items()}

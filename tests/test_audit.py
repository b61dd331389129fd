import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import audit as ops
from palimpsest.sources.audit_store import AuditStore, split_rotation
from palimpsest.streaming import streams

NOW = dt.datetime(2024, 5, 10, 12)


def entries(spark, rows):
    """Rows of (id, age in hours, agent, provider, tier, redactions)."""
    return spark.createDataFrame(
        [(i, NOW - dt.timedelta(hours=age), a, p, "read", None, t, r, False, None) for i, age, a, p, t, r in rows],
        ops.AUDIT_SCHEMA,
    )


FOUR = [
    ("1", 1, "claude", "anthropic", "redacted", '{"ips":2}'),
    ("2", 2, "claude", "anthropic", "public", None),
    ("3", 3, "codex", "openai", "blocked", "null"),
    ("4", 30, "codex", "mistral", "local-only", '{"ips":5,"email":1}'),
]


def test_summary(spark):
    got = {(r["dimension"], r["key"]): (r["entries"], r["redacted"]) for r in ops.summary(entries(spark, FOUR)).collect()}
    assert got[("total", "")] == (4, 2)
    assert [got[("tier", t)] for t in ("redacted", "public", "blocked", "local-only")] == [(1, 1), (1, 0), (1, 0), (1, 1)]
    assert got[("agent", "claude")] == (2, 1) and got[("provider", "anthropic")] == (2, 1)
    since = {(r["dimension"], r["key"]): r["entries"] for r in ops.summary(entries(spark, FOUR), NOW - dt.timedelta(hours=24)).collect()}
    assert since[("total", "")] == 3 and ("provider", "mistral") not in since
    empty = ops.summary(entries(spark, [])).collect()
    assert [tuple(r) for r in empty] == [("total", "", 0, 0)]


def test_totals(spark):
    assert {tuple(r) for r in ops.redaction_totals(entries(spark, FOUR)).collect()} == {("ips", 7, 2), ("email", 1, 1)}


def test_recent_and_filters(spark):
    many = entries(spark, [(f"{i:04d}", i // 2, f"a{i % 2}", "p", "public", None) for i in range(250)])
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(ops.recent(many, limit=3)) == ["0001", "0000", "0003"]
    assert len(ids(ops.recent(many, limit=0))) == 100 and len(ids(ops.recent(many, limit=10_001))) == 100
    assert ids(ops.recent(many, "a1", limit=2)) == ["0001", "0003"]
    assert len(ids(ops.all_entries(many))) == 250
    assert len(ids(ops.entries(many, since=NOW - dt.timedelta(hours=1)))) == 4
    plan = ops.recent(many)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_since():
    ago = lambda text: NOW - ops.parse_since(text, NOW)
    assert ops.parse_since("", NOW) is None
    assert ago("7d") == dt.timedelta(days=7) and ago("2h") == dt.timedelta(hours=2)
    assert ago("1h30m") == dt.timedelta(minutes=90) and ago("1.5s") == dt.timedelta(seconds=1.5)
    assert ago("-2h") == dt.timedelta(hours=-2) and ago("0") == dt.timedelta(0)
    for unreadable in ("x", "7", "d", "1x", "h"):
        assert ago(unreadable) == dt.timedelta(days=1)


def test_rotation_takes_exactly_what_it_archives(spark, tmp_path):
    young = [(f"y{i}", 1, "a", "p", "public", '{"email":1}') for i in range(150)]
    old = [(f"o{i}", 48, "a", "p", "public", None) for i in range(50)]
    store = AuditStore(spark, str(tmp_path / "store"))
    store.append(entries(spark, young + old))
    assert store.read().count() == 200
    assert store.export(str(tmp_path / "all")) == 200
    assert store.rotate(str(tmp_path / "archive"), NOW - dt.timedelta(hours=24), NOW) == 150
    archived = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "archive")).collect()]
    assert len(archived) == 150 and {e["id"][0] for e in archived} == {"y"}
    assert store.read().filter("id LIKE 'o%'").count() == store.read().count() == 50
    # entries appended afterwards are kept, and a second rotation takes the rest
    store.append(entries(spark, [("late", -1, "a", "p", "public", None)]))
    assert store.read().count() == 51
    assert store.rotate(str(tmp_path / "second"), None, NOW + dt.timedelta(hours=2)) == 51
    assert store.read().count() == 0
    assert store.export(str(tmp_path / "none")) == 0


def test_batch_and_stream_writers_share_a_store(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path / "store"))
    store.append(entries(spark, FOUR[:1]))
    entries(spark, FOUR[1:2]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ops.AUDIT_SCHEMA).parquet(str(tmp_path / "in"))
    store.append_stream(stream, str(tmp_path / "cp")).awaitTermination()
    store.append(entries(spark, FOUR[2:]))
    assert sorted(r["id"] for r in store.read().collect()) == ["1", "2", "3", "4"]


def test_rotation_keeps_what_is_appended_later_with_an_older_stamp(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path / "store"))
    store.append(entries(spark, FOUR))
    assert store.rotate(str(tmp_path / "first"), NOW - dt.timedelta(hours=24), NOW) == 3
    store.append(entries(spark, [("late", 2, "a", "p", "public", None)]))
    assert sorted(r["id"] for r in store.read().collect()) == ["4", "late"]
    assert store.rotate(str(tmp_path / "second"), None, NOW) == 2 and store.read().count() == 0


def test_a_store_written_under_another_time_zone_loses_nothing(spark, tmp_path):
    store, zone = AuditStore(spark, str(tmp_path / "store")), "spark.sql.session.timeZone"
    found = entries(spark, [(str(i), i / 2, "a", "p", "public", None) for i in range(96)])
    before = spark.conf.get(zone)
    spark.conf.set(zone, "America/Los_Angeles")
    try:
        store.append(found)
    finally:
        spark.conf.set(zone, before)
    since = NOW - dt.timedelta(hours=20)
    assert store.read().filter("date = to_date(ts)").count() == 96
    assert ops.entries(store.read(), since=since).count() == 41
    assert store.rotate(str(tmp_path / "archive"), since, NOW) == 41 and store.read().count() == 55


def test_entries_without_a_stamp_get_one(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path / "store"))
    store.append(entries(spark, FOUR).withColumn("ts", F.lit(None).cast("timestamp")))
    assert store.read().filter("ts = appended").count() == 4


def test_split_rotation(spark):
    archived, retained = split_rotation(entries(spark, FOUR), NOW - dt.timedelta(hours=2), NOW - dt.timedelta(hours=1))
    assert {r["id"] for r in archived.collect()} == {"1", "2"} and {r["id"] for r in retained.collect()} == {"3", "4"}


def test_filters_reach_the_files(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path / "store"))
    store.append(entries(spark, FOUR))
    plan = ops.entries(store.read(), "codex", NOW - dt.timedelta(hours=24))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(agent,codex)" in plan and "GreaterThanOrEqual(ts" in plan


def test_a_failed_append_target_is_reported(spark, tmp_path):
    with pytest.raises(Exception):
        AuditStore(spark, str(tmp_path / "nowhere")).read().count()


def test_tail_shows_each_entry_once(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path / "store"))
    store.append(entries(spark, FOUR))
    for _ in range(2):
        tail = streams.audit_tail(spark, str(tmp_path / "store/entries"), "codex").select("id")
        streams.run_available(tail, str(tmp_path / "out"), str(tmp_path / "cp"))
    store.append(entries(spark, [("5", 0, "codex", "p", "public", None), ("6", 0, "x", "p", "public", None)]))
    streams.run_available(streams.audit_tail(spark, str(tmp_path / "store/entries"), "codex").select("id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["3", "4", "5"]
    history = streams.audit_history(entries(spark, [(str(i), i / 60, "a", "p", "public", None) for i in range(20)]), "", NOW)
    assert [r["id"] for r in history.collect()] == ["5", "4", "3", "2", "1", "0"]


def test_stream_append(spark, tmp_path):
    source = entries(spark, FOUR)
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    store = AuditStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        store.append_stream(stream, str(tmp_path / "cp")).awaitTermination()
    assert store.read().count() == 4
    assert store.read().select(F.countDistinct("date")).first()[0] == 2

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import risk, traffic
from palimpsest.operators.audit import unresolved_entries, unresolved_of_rows
from palimpsest.sources.audit_store import AuditStore


def test_sketched_quantiles_are_within_their_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("source"), F.rand(3).alias("density"))
    rows = rows.union(spark.createDataFrame([(None, 0.5)], "source string, density double")).cache()
    exact = {}
    for r in rows.collect():
        exact.setdefault(r["source"], []).append(r["density"])
    for r in risk.usual_density(rows, accuracy=100).collect():
        own = np.sort(exact[r["usual_of"]])
        rank = np.searchsorted(own, r["usual"], side="right")
        assert r["texts"] == len(own) and abs(rank - 0.99 * len(own)) <= len(own) / 100 + 1


def test_risks(spark):
    rows = spark.createDataFrame(
        [(1, "a", 9.0, 9, 0), (2, "a", 9.0, 9, 1), (3, "a", 1.0, 9, 1), (4, "a", 9.0, 1, 0), (5, "new", 99.0, 9, 0), (6, None, 9.0, 9, 0), (7, "a", None, 9, 0)],
        "id int, source string, density double, matches int, encoded int",
    )
    usual = spark.createDataFrame([("a", 2.0), (None, 3.0)], "usual_of string, usual double")
    got = {r["id"]: r["bypass_risk"] for r in risk.bypass_risk(rows, usual).collect()}
    assert got == {1: risk.DENSE, 2: risk.REVIEW, 3: risk.ENCODED, 4: risk.NONE, 5: risk.NONE, 6: risk.DENSE, 7: risk.NONE}


@pytest.mark.parametrize("most", [1000, 1])
def test_owners_of_keys(spark, most):
    requests = spark.createDataFrame(
        [(1, "team", "k1", "aider"), (2, None, "k1", "aider"), (3, "", "k2", "aider"), (4, None, "none", "aider 1"), (5, None, None, None), (6, None, "", "x")],
        "id int, header string, api_key string, user_agent string",
    )
    keys = spark.createDataFrame([("k1", "old", 1), ("k1", "new", 2), ("k1", "later", 2), ("k2", "b", None), (None, "n", 3)], "key string, agent_name string, registered_at bigint")
    keys = keys.select(F.when(F.col("key").isNotNull(), traffic.key_hash(F.col("key"))).alias("key_hash"), "agent_name", "registered_at")
    found = traffic.detect_agent_by_key(requests, keys, most=most)
    assert found.columns == [*requests.columns, "agent"]
    assert {r["id"]: r["agent"] for r in found.collect()} == {1: "team", 2: "later", 3: "b", 4: "aider", 5: "unknown", 6: "ua:x"}
    assert traffic.detect_agent_by_key(requests, keys.limit(0)).count() == 6


def test_unresolved_entries_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "x [TG:IP:1] [TG:IP:1] [TG:IP:2]", ["[TG:IP:2]"]), ("a|b", "[TG:IP:1]", None), (None, "[TG:EMAIL:3]", []), ("c", None, ["q"])],
        "scope string, text string, tokens array<string>",
    )
    found = unresolved_of_rows(rows, ["scope"], "text", "tokens")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("a", "[TG:IP:1]", 2), ("a|b", "[TG:IP:1]", 1), (None, "[TG:EMAIL:3]", 1)], key=repr)
    entries = unresolved_entries(found, ["scope"], ts=F.lit(dt.datetime(2024, 1, 1)))
    store = AuditStore(spark, str(tmp_path / "store"))
    store.append_missing(entries.limit(1))
    store.append_missing(entries.union(entries))
    store.append_missing(entries)
    assert store.read().count() == 3 and store.read().select("id").distinct().count() == 3
    other = entries.withColumn("id", F.concat("id", F.lit("-2")))
    # A failed attempt leaves a folder that is not whole.
    store.append(other.limit(1), once="job")
    (tmp_path / "store" / "entries" / "batch=once-job" / "_SUCCESS").unlink()
    for _ in range(3):
        store.append(other, once="job")
    assert store.read().count() == 6
    store.append(other)
    assert store.read().count() == 9

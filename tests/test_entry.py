import pytest

import __spark_entry__ as contract
from suite.oracles import ORACLES
from suite.queries import QUERIES

NAMES = sorted(QUERIES)


def test_every_query_has_a_counterpart():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(contract.queries())


def test_flagship(spark):
    result = contract.entry(spark)
    assert result.columns == ["doc_id", "text", "matches", "values"] and result.count() == 200


def _key(value):
    if value is None or value != value:
        return "\0"
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations", "labels", "events", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_duckdb(spark, sf_dir, duck, name):
    got = contract.queries()[name](spark, sf_dir)
    cursor = duck.execute(contract.oracle_sql()[name])
    columns = sorted(d[0] for d in cursor.description)
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted(tuple(_key(row[i]) for i in order) for row in cursor.fetchall())
    assert sorted(got.columns) == columns
    assert sorted(tuple(_key(v) for v in row) for row in got.select(columns).collect()) == want

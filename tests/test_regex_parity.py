"""Values found by the Java forms against RE2 (DuckDB), pattern by pattern."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.patterns import CATALOG
from palimpsest.operators.detect import find_values

duckdb = pytest.importorskip("duckdb")

ATOMS = [
    "a", "b", "x", "F", "Z", "_", "-", ".", "@", ":", "/", "+", "(", ")", " ", " ", "\n", "\r", "\t", "\v", "\u0085", " ", "é",
    "ſ", "K", "%", "!", "*", "$", "'", '"', "=", ",", "0", "1", "7", "10", "25", "255", "172.", "192.168.", "10.0.0.1",
    "203.0.113.9", "4111", "4111 1111 ", "1111-", "123-45-6789", "555", "123", "4567", "(555) ", "+1 ", "+49", "ab:cd:", "00:1b:44:",
    "2001:db8:", "fe80:", "u@ex.org", "a.b@", "com", ".io", "localhost", ".local", ".lan", ".internal", "q-", "AB12", "DE89ABCD1234567",
    "C01234567", "a" * 35, "a" * 36, "_" * 4, "eyJab", ".eyJcd.", "sk-proj-", "sk-ant-", "sk_live_", "ghp_", "github_pat_", "AKIA", "AIza",
    "xoxb-", "glpat-", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "Bearer ", "BEARER\t", "bearer", "postgres://", "redis://x",
    "aws_secret_access_key", "AWS_SECRET_ACCESS_KEY: ", "A1b2/+=" * 6, "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----",
    "-----BEGIN RSA PRIVATE KEY-----", "\nroot:x:0:0:", "\nsid:!:1:2:", "user::1:1:", "\nSep  3 17:54:01 ", "web-1 ", "sshd[4]: ", "cron:",
    "\n2026-09-03T17:54:03Z ", "\n2026-09-03T17:54:03.5+02:00 ",
]


def test_java_forms_find_what_re2_finds(spark):
    rng = random.Random(20)
    texts = ["".join(rng.choice(ATOMS) for _ in range(rng.randrange(1, 16))) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    got = df.select("i", *(find_values(F.col("text"), p).alias(p.name) for p in CATALOG)).orderBy("i").collect()

    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [[i, t] for i, t in enumerate(texts)])
    for p in CATALOG:
        regex = p.regex.replace("'", "''")
        want = con.execute(f"SELECT regexp_extract_all(text, '{regex}', {p.group}) FROM t ORDER BY i").fetchall()
        wrong = [(t, row[p.name], w) for t, row, (w,) in zip(texts, got, want) if list(row[p.name]) != list(w)]
        assert not wrong, (p.name, len(wrong), wrong[0])
    assert sum(len(row[p.name]) > 0 for row in got for p in CATALOG) > 1500

import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import conversations
from palimpsest.llm.conversations import damage, repair_conversations, repaired_turns
from palimpsest.llm.queries import ORACLES, QUERIES
from tests.llm import brute

SCHEMA = "conv_id bigint, turn bigint, role string, text string, fault string, conv string, first int"
_RANDOM = random.Random(3)


def _conversations():
    roles = ["user", "assistant", "system", "tool", "", None, "u2", "User"]
    texts = ["a b.", "c d!", "cut off", "", " \t\n", None, "e?\n", "é", "日本.", "a\nb.\x00."]
    rows = []
    for conv in [None, -(1 << 63), (1 << 63) - 1, *range(150)]:
        for _ in range(_RANDOM.randint(1, 4)):
            weights = [6, 6, 2, 1, 1, 1, 1, 1]
            turn = _RANDOM.choice([None, 0, 1, 2, 3, 7, 40])
            rows.append((conv, turn, _RANDOM.choices(roles, weights)[0], _RANDOM.choice(texts)))
    return rows + rows[:20]


def _in_order(rows):
    """As the operator takes them: by turn, then role and text by code point."""
    clean = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(clean, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def _expected(rows):
    rows = _in_order(rows)
    seen, faults, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        end = re.search(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)", text)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end.group() not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        counts[fault] = counts.get(fault, 0) + 1
    best = (4 * len(rows) + 1, "")

    def search(i, cost, edits, roles, lines):
        """All edits in turn; those already dearer than the best are left."""
        nonlocal best, found
        if cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(roles)) and ((cost, edits) < best or found is None):
            best, found = (cost, edits), lines
        if edits[-2:] != "II":
            for role in ("user", "assistant"):
                search(i, cost + 3, edits + "I", [*roles, role[0]], [*lines, f"{role}:"])
        if i < len(rows):
            _, role, text = rows[i]
            search(i + 1, cost + 4, edits + "D", roles, lines)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                search(i + 1, cost + more, edits + "K", [*roles, role[:1] or "?"], [*lines, f"{role}:{text}"])
                for other in ("user", "assistant"):
                    search(i + 1, cost + 3 + more, edits + "R", [*roles, other[0]], [*lines, f"{other}:{text}"])

    found = None
    search(0, 0, "", [], [])
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, *best, brute.sha("\n".join(found).encode())), found


def test_cheapest_edits_against_all_edits(spark):
    rows = _conversations()
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair_conversations(frame).collect()}
    by_conv = {}
    for conv, *row in rows:
        by_conv.setdefault(conv, []).append(row)
    want = {conv: _expected(own) for conv, own in by_conv.items()}
    assert got == {conv: w for conv, (w, _) in want.items()}
    left = {}
    for r in repaired_turns(frame, repair_conversations(frame)).collect():
        left.setdefault(r["conv_id"], []).append((r["place"], f"{r['role']}:{r['text']}"))
    assert {c: [x for _, x in sorted(own)] for c, own in left.items()} == {c: lines for c, (_, lines) in want.items() if lines}


def test_damage_and_conversations_of_which_nothing_is_left(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Turn {t} of {c}. Yes!") for c in range(150) for t in range(1 + c % 3)]
    rows += [(None, None, None, None), (161, None, None, "a.")]
    kept = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[c] += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert [] in kept.values()
    frame, gone, copies = damage(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r["conv_id"]: tuple(r)[1:] for r in repair_conversations(frame, gone=gone, copies=copies).collect()}
    assert got == {c: _expected(own)[0] for c, own in kept.items()}


def test_text_keys_and_empty_table(spark):
    frame = spark.createDataFrame([("b", 1, "user", "x."), ("a", 1, "user", "x."), ("a", 2, "assistant", "y.")], "c string, n int, r string, t string")
    got = repair_conversations(frame, "c", "n", "r", "t")
    assert sorted((r["conv_id"], r["audit"]) for r in got.collect()) == [("a", "KK"), ("b", "KI")]
    assert repair_conversations(frame.limit(0), "c", "n", "r", "t").collect() == []


@pytest.mark.parametrize("held", [3, 300])
def test_back_pointers_in_a_file(monkeypatch, held):
    rows = [(_RANDOM.choice(["user", "assistant", "system", "tool"]), f"{i}.", _RANDOM.choice(["", "", "truncated", "blank"])) for i in range(500)]

    def run():
        moves, one = {}, conversations._Repair("c")
        for i, (role, text, fault) in enumerate(rows):
            one.add(i, role, text, fault, moves)
        assert len(one.pointers) < conversations.HELD
        return one.result()

    whole = run()
    monkeypatch.setattr(conversations, "HELD", held)
    assert run() == whole and len(whole[-2]) >= 500


@pytest.mark.parametrize("edge", [False, True])
def test_same_as_sql(spark, tmp_path, sf_dir, edge):
    folder = sf_dir
    if edge:
        rows = [r for r in _conversations()]
        spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
        folder = str(tmp_path)
    con = duckdb.connect()
    files = f"{folder}/conversations.parquet" + ("/*.parquet" if edge else "")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{files}'")
    want = con.execute(ORACLES["op12_conversation_repair"])
    columns = [d[0] for d in want.description]
    got = QUERIES["op12_conversation_repair"](spark, folder).select([F.col(c) for c in columns])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))

import pandas as pd

import pyarrow as pa
import pytest
from pyspark.sql import Row

from palimpsest.streaming import responses
from palimpsest.streaming.responses import _Restorer, _RowRestorer


class State:
    """One state variable; counts what is asked of it."""

    def __init__(self):
        self.entries, self.value, self.list, self.asked = {}, None, [], 0

    def containsKey(self, key):
        self.asked += 1
        return key in self.entries

    def getValue(self, key):
        self.asked += 1
        return self.entries[key]

    def updateValue(self, key, value):
        self.entries[key] = value

    def exists(self):
        return self.value is not None or bool(self.list)

    def get(self):
        return self.value if self.value is not None else iter(self.list)

    def update(self, value):
        self.value = value

    def appendList(self, rows):
        self.list += rows

    def clear(self):
        self.entries, self.value, self.list = {}, None, []


class Handle:
    def __init__(self):
        self.states = {}

    def _state(self, name, *_):
        return self.states.setdefault(name, State())

    getMapState = getValueState = getListState = _state

    def registerTimer(self, at):
        pass


def batch(*rows):
    return iter([pd.DataFrame(rows, columns=["kind", "seq", "chunk", "is_last", "tokens", "values", "ms"])])


def test_state_is_asked_only_for_what_it_may_have():
    handle, restorer = Handle(), _Restorer(1000)
    restorer.init(handle)
    mapping = ("mapping", 0, None, False, ["[TG:IP:1]", "[TG:IP:1]", "[TG:IP:2]"], ["a", "b", "c"], 5)
    late = ("chunk", 1, " [TG:IP:1] [TG:IP:3]", True, None, None, 6)
    (out,) = restorer.handleInputRows(("r",), batch(mapping, late, ("chunk", 0, "x", False, None, None, 5)), None)
    assert out["text"].tolist() == ["x", " [TG:IP:1] [TG:IP:3]"] and out["values"].tolist() == [[], ["a"]]
    assert handle.states["mapping"].asked == 0
    again = ("mapping", 0, None, False, ["[TG:IP:1]", "[TG:IP:3]"], ["z", "d"], 7)
    (out,) = restorer.handleInputRows(("r",), batch(again, ("chunk", 2, "[TG:IP:1][TG:IP:2][TG:IP:3]", True, None, None, 7)), None)
    assert out["values"].tolist() == [["a", "d", "c"]]


_EVENT = Row("kind", "seqs", "chunks", "lasts", "tokens", "values", "ms")


def _calls(monkeypatch):
    """Every call to the state, in order."""
    made = []
    for name in ("containsKey", "getValue", "updateValue", "exists", "get", "update", "appendList", "clear"):
        monkeypatch.setattr(State, name, lambda self, *a, f=getattr(State, name), n=name: (made.append(n), f(self, *a))[1])
    monkeypatch.setattr(Handle, "registerTimer", lambda self, at: made.append("registerTimer"))
    return made


class Watermark:
    def getCurrentWatermarkInMs(self):
        return 10_000


@pytest.mark.parametrize("entries", [3, 50])
def test_few_calls_to_the_state_for_a_response(monkeypatch, entries):
    handle, restorer = Handle(), _RowRestorer(1000)
    restorer.init(handle)
    made = _calls(monkeypatch)
    mapping = _EVENT("mapping", None, None, None, [f"[TG:IP:{n}]" for n in range(entries)], [f"v{n}" for n in range(entries)], 5)
    assert list(restorer.handleInputRows(("r",), iter([mapping]), None)) == []
    assert made == ["get"] + ["updateValue"] * (entries if entries > responses.FEW else 0) + ["registerTimer", "update"]
    made.clear()
    chunks = _EVENT("chunk", [2, 0, 1], [":1] x [T", "a [TG:IP:2] ", "[TG:IP"], [False] * 3, None, None, 6)
    out = list(restorer.handleInputRows(("r",), iter([chunks]), None))
    assert [(r.seq, r.text, r["tokens"], r["values"]) for r in out] == [(0, "a [TG:IP:2] ", ["[TG:IP:2]"], ["v2"]), (2, "[TG:IP:1] x ", ["[TG:IP:1]"], ["v1"])]
    assert [c for c in made if c not in ("containsKey", "getValue")] == ["get", "update"]
    assert len(made) == (2 if entries <= responses.FEW else 6)
    made.clear()
    out = list(restorer.handleExpiredTimer(("r",), Watermark(), None))
    assert [(r.seq, r.part, r.text) for r in out] == [(2, 1, "[T")]
    assert made == ["get"] + ["clear"] * (1 if entries <= responses.FEW else 2)
    assert list(restorer.handleInputRows(("r",), iter([_EVENT("chunk", [3], ["[TG:IP:2]"], [True], None, None, 9)]), None)) == []


def test_a_mapping_that_grows_keeps_its_first_entries(monkeypatch):
    monkeypatch.setattr(responses, "FEW", 2)
    handle, restorer = Handle(), _RowRestorer(1000)
    restorer.init(handle)
    grow = [(["[TG:IP:1]"], ["a"]), (["[TG:IP:1]", "[TG:IP:2]", "[TG:IP:3]"], ["z", "b", "c"]), (["[TG:IP:3]", "[TG:IP:4]", "[TG:IP:1]"], ["y", "d", "x"])]
    for tokens, values in grow:
        assert list(restorer.handleInputRows(("r",), iter([_EVENT("mapping", None, None, None, tokens, values, 5)]), None)) == []
    text = "[TG:IP:4][TG:IP:3][TG:IP:2][TG:IP:1]"
    (out,) = restorer.handleInputRows(("r",), iter([_EVENT("chunk", [0], [text], [True], None, None, 6)]), None)
    assert dict(zip(out["tokens"], out["values"])) == {"[TG:IP:1]": "a", "[TG:IP:2]": "b", "[TG:IP:3]": "c", "[TG:IP:4]": "d"}
    assert list(handle.states["mapping"].entries) == [("[TG:IP:2]",), ("[TG:IP:3]",)]


def test_chunks_that_follow_one_another_are_one_row():
    ids, n = ["a", "a", None, None, "b", "a"], range(6)
    micros = pa.array([3, 7, None, None, 5, 1], pa.int64())
    columns = [pa.array(ids), pa.array(n, pa.int64()), pa.array([f"t{i}" for i in n]), pa.array([i == 1 for i in n]), micros]
    (out,) = responses._together(iter([pa.RecordBatch.from_arrays(columns, names=list("rsclm"))]))
    assert [tuple(r.values()) for r in out.to_pylist()] == [
        ("a", [0, 1], ["t0", "t1"], [False, True], 7), (None, [2, 3], ["t2", "t3"], [False, False], None),
        ("b", [4], ["t4"], [False], 5), ("a", [5], ["t5"], [False], 1),
    ]


def test_what_is_held_at_the_end_of_a_text():
    restorer = _Restorer(1000)
    restorer.init(Handle())
    for text in ("", "x", "a [TG:I", "[", "[TG:IP:1]", "x TG_IP_1", "'TG:IP", "é [T", "T" * 200, "x" * 70 + "`TG", "[[TG:EMAIL:12", "A] [TG", "\n"):
        assert restorer._held(text) == restorer.tail.search(text[-responses.MAX_TAIL :]).group()

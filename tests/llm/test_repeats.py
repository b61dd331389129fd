import dataclasses
import random

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import fm_index, repeats, suffix_array
from tests.llm import brute


def test_runs_are_joined_as_their_bytes_are():
    rng = np.random.default_rng(3)
    for _ in range(300):
        starts = rng.integers(0, 40, rng.integers(1, 9))
        ends = starts + rng.integers(1, 9, len(starts))
        covered = np.zeros(50, dtype=bool)
        for a, b in zip(starts, ends):
            covered[a:b] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        assert repeats._joined(starts, ends) == list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def test_the_last_step_hashes_no_units(monkeypatch):
    made = []
    parts = repeats._parts
    monkeypatch.setattr(repeats, "_parts", lambda *a, **k: (made.append(p) or p for p in parts(*a, **k)))
    runs = pa.array([[{"start": 1, "n": 2}, {"start": 2, "n": 3}, {"start": 7, "n": 1}], None, []], pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))
    rows = pa.record_batch({"d": pa.array([1, 2, 3]), "th": pa.array([0, 0, 0]), "text": pa.array(["abcdefgh", "xy", ""]), "runs": runs})
    (out,) = repeats._removed(suffix_array.KIND)(iter([rows]))
    assert out.column("kept").to_pylist() == [b"afg", b"xy", b""]
    assert out.column("n_removed").to_pylist() == [5, 0, 0] and out.column("n_spans").to_pylist() == [2, 0, 0]
    assert made and not any(len(p.units) for p in made)


def _one_table(batches):
    return pa.Table.from_batches(list(batches))


def _sorted_batch(table, *keys):
    (batch,) = table.sort_by([(k, "ascending") for k in keys]).combine_chunks().to_batches()
    return batch


def _marks(kind, batches):
    """What the anchors' exchange gives for texts that come in these batches."""
    found = _sorted_batch(_one_table(m for b in batches for m in repeats._anchors(kind)(iter([b]))), "v", "salt")
    return _one_table(repeats._repeated(kind)(iter([found]))).to_pylist()


def _documents(texts, first=0):
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(texts)), pa.int64()), pa.array(texts)], names=["d", "text"])


def _prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(n))


def test_an_anchor_of_many_batches_is_not_hot_while_its_pieces_fit_a_shard():
    """Else common passages are dealt out byte by byte as soon as the table has many batches."""
    passage = _prose(random.Random(5), 60)
    marks = _marks(suffix_array.KIND, [_documents([passage], k) for k in range(300)])
    assert len({m["d"] for m in marks}) == 300 and not any(m["hot"] for m in marks)


@pytest.mark.parametrize("kind, units", [(suffix_array.KIND, 3000), (fm_index.KIND, 200)])
def test_windows_of_hot_anchors_are_handed_on_in_steps(monkeypatch, kind, units):
    monkeypatch.setattr(repeats, "BODIES", 10_000)
    kind = dataclasses.replace(kind, shard_units=units)
    rng = random.Random(7)
    passage = _prose(rng, 60)
    texts = [f"{_prose(rng, 40)} {passage} {_prose(rng, 40)}" for _ in range(60)]
    texts += texts[:7] + [passage, "ab " * 400, "", "short"]
    marks = _marks(kind, [_documents(texts)])
    hot = {m["v"] for m in marks if m["hot"]}
    assert hot
    own = [[{"v": v, "hot": v in hot} for v in {m["v"] for m in marks if m["d"] == d and not m["hot"]}] for d in range(len(texts))]
    columns = [*_documents(texts).columns, pa.array(range(len(texts)), pa.int64()), pa.array(own, pa.list_(pa.struct([("v", pa.int64()), ("hot", pa.bool_())])))]
    made = list(repeats._pieces(kind)(iter([pa.RecordBatch.from_arrays(columns, names=["d", "text", "th", "marks"])])))
    sizes = [sum(len(b) for b in m.column("body").to_pylist() if b) for m in made]
    assert len(made) > 5 and max(sizes) < 2 * repeats.BODIES
    pieces = pa.Table.from_batches(made).to_pylist()
    bodies = [p["body"] for p in pieces if p["body"] is not None]
    assert len(set(bodies)) == len(bodies) < len(pieces)
    found = _one_table(repeats._resolve(kind)(iter([_sorted_batch(pa.Table.from_batches(made), "v", "salt", "d", "th", "start")])))
    units = [brute.words(t) if kind.words else list(t.encode()) for t in texts]
    got = [bytearray(len(u)) for u in units]
    for r in found.to_pylist():
        got[r["d"]][r["start"] : r["start"] + r["n"]] = b"\x01" * r["n"]
    assert got == brute.covered(units, kind.window)


def test_what_a_shard_finds_are_stretches_and_not_rows_for_every_unit():
    rng = random.Random(11)
    kind = suffix_array.KIND
    passage = _prose(rng, 40)
    bodies = [x + passage + y for x, y in (("a", "b"), ("c", "d"))]
    rows = {
        "v": [1, 1], "salt": [0, 0], "d": [1, 2], "th": [0, 0], "start": [0, 50], "n": [len(b) - kind.window + 1 for b in bodies],
        "inner": [False, False], "body": [b.encode() for b in bodies],
    }
    (batch,) = pa.table(rows).to_batches()
    found = _one_table(repeats._resolve(kind)(iter([batch]))).to_pylist()
    assert found == [{"d": 2, "th": 0, "start": 51, "n": len(passage)}]


def test_a_shard_holds_no_more_than_its_units():
    """Several anchors' pieces fill half a shard; one that needs more of it has a shard of its own."""
    rng = random.Random(13)
    sizes: list[int] = []

    def index(text, starts, window):
        sizes.append(len(text))
        return suffix_array.window_classes(text, starts, window)

    kind = dataclasses.replace(suffix_array.KIND, shard_units=4000, index=index)
    rows = []
    for v, pieces in enumerate([8, 28, 8, 8, 3]):
        passage = _prose(rng, 40)[:100]
        rows += [{"v": v, "salt": 0, "d": len(rows) + i, "th": 0, "start": 0, "n": 21, "inner": False, "body": f"{10 + i}{passage}{_prose(rng, 9)[:18]}".encode()} for i in range(pieces)]
    (batch,) = pa.Table.from_pylist(rows).to_batches()
    found = _one_table(repeats._resolve(kind)(iter([batch])))
    assert found.num_rows == sum(n - 1 for n in (8, 28, 8, 8, 3)) and max(sizes) <= kind.shard_units and len(sizes) == 3

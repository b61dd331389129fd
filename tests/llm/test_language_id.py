import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from palimpsest.llm import language_id
from palimpsest.llm.language_id import Fit, Lattice, fit, identify, letter_pieces
from palimpsest.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = (b" ", b" a", b" ab", b"a", b"aa", b"ab", b"aba", b"b", b"ba")
CHANCES = np.array([[0.1, 0.2], [0.1, 0.05], [0.2, 0.05], [0.1, 0.1], [0.05, 0.1], [0.2, 0.1], [0.05, 0.1], [0.1, 0.1], [0.1, 0.2]])


def _segmentations(text):
    if not text:
        yield ()
    for i, p in enumerate(PIECES):
        if text.startswith(p):
            yield from ((i, *rest) for rest in _segmentations(text[len(p) :]))


def _all(word, lang, stretch):
    """Probability and expected counts of a word, one segmentation after the other."""
    total, counts = 1.0, Counter()
    text = b" " + word
    for at in range(0, len(text), stretch):
        found = [(math.prod(CHANCES[i, lang] for i in s), s) for s in _segmentations(text[at : at + stretch])]
        part = sum(p for p, _ in found)
        total *= part
        for p, s in found:
            for i in s:
                counts[i] += p / part
    return total, counts


@pytest.mark.parametrize("stretch", [32, 5])
def test_sums_over_all_segmentations(monkeypatch, stretch):
    monkeypatch.setattr(language_id, "STRETCH", stretch)
    rng = random.Random(2)
    words = ["a", "b", *("".join(rng.choice("ab") for _ in range(rng.randint(1, 13))) for _ in range(40))]
    lattice = Lattice(pa.array([w.encode() for w in words], pa.large_binary()), language_id._Trie(PIECES))
    times = np.arange(1, len(words) + 1)
    expected = Counter()
    for lang in range(2):
        logs = lattice.logs(CHANCES)[:, lang]
        for w, got in zip(words, logs):
            assert math.exp(got) == pytest.approx(_all(w.encode(), lang, stretch)[0])
    for w, n in zip(words, times):
        for i, c in _all(w.encode(), 1, stretch)[1].items():
            expected[i] += n * c
    assert lattice.counts(CHANCES[:, [1]], times) == pytest.approx([expected[i] for i in range(len(PIECES))])


def test_pieces_of_the_vocabulary():
    pieces = letter_pieces(PATH)
    assert {b"a", b" ", b"\xc3", b" the", b"ing"} <= set(pieces) and not {b" The", b"1", b"  ", b".", b"'s"} & set(pieces)
    assert len(pieces) > 10_000


def test_held_out_languages(spark, sf_dir):
    got = QUERIES["op11_language_id"](spark, sf_dir).collect()
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(truth)
    right = Counter()
    for r in got:
        lang, text = truth[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        if r["held_out"] and r["lang_pred"] != "und":
            right[lang, r["lang_pred"] == lang] += 1
    # By language, so that always naming the commonest fails.
    assert all(right[x, True] / (right[x, True] + right[x, False]) >= 0.9 for x in {x for x, _ in right})


TRAIN = [(1, "a", "the house and the tree " * 3), (2, "b", "das haus und der baum " * 3), (3, None, "zzz"), (4, "b", None), (5, "ж", "дом и дерево " * 5), (6, "a", "")]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, lang string, text string, score int, lang_pred string")


def test_corner_cases(spark):
    model = fit(_frame(spark, TRAIN), PATH)
    assert model.languages == ("a", "b", "ж") and np.allclose(model.chances.sum(axis=0), 1)
    texts = {
        None: "the tree", 1: None, 2: "", 3: " \t\n", 4: "12 + 34 = 46!", 5: "THE HOUSE", 6: "Haus", 7: "ДЕРЕВО", 8: "́",
        9: "ét", 10: "the " * 300_000, 11: "der" * 40_000 + " und der baum" * 90_000, 12: "日本語のテキスト", 13: "a\x00b  tree", 14: "𐐀𐐁 ß",
    }
    docs = _frame(spark, [(i, None, t) for i, t in texts.items()] + [(5, None, "THE HOUSE")])
    found = identify(docs, model).collect()
    assert len(found) == len(texts) + 1
    got = {r["doc_id"]: r["lang_pred"] for r in found}
    assert {i for i, x in got.items() if x == "und"} == {1, 2, 3, 4, 8}
    assert all(r["score"] == 0 for r in found if r["lang_pred"] == "und") and all(0 <= r["score"] <= 1 for r in found)
    assert (got[None], got[5], got[6], got[7], got[10], got[11]) == ("a", "a", "b", "ж", "a", "b")
    assert identify(docs.limit(0), model).collect() == []


def test_without_labels_and_with_too_many(spark):
    docs = _frame(spark, TRAIN)
    model = fit(docs.filter("false"), PATH)
    assert {(r["lang_pred"], r["score"]) for r in identify(docs, model).collect()} == {("und", 0.0)}
    with pytest.raises(ValueError):
        fit(docs, PATH, bounds=Fit(languages=2))


def test_copies_count_once(spark):
    docs = _frame(spark, TRAIN)
    many = docs.crossJoin(spark.range(20).select())
    bounds = Fit(documents=2000)
    a, b = fit(docs, PATH, bounds=bounds), fit(many, PATH, bounds=bounds)
    assert np.allclose(a.chances, b.chances) and np.allclose(a.shares, b.shares)

import math
import re
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import lexical_search
from palimpsest.llm.lexical_search import rank_documents, tiles
from tests.llm import brute

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall((text or "").translate(brute.LOWER))


def _ranked(docs, items, k=20):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    n = sum(1 for _, c in counts if c)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    found = set()
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * n // length if length else 0
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in _terms(text) if c[t]
            )
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        found |= {(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)}
    return found


ITEMS = [(1, "The cat, the CAT sat"), (1, "The cat, the CAT sat"), (2, None), (3, ""), (4, "... !"), (None, "ÉTÉ été 日本"), (5, "zz9 absent"), (6, "same")]
DOCS = [
    (5, "the cat sat"), (3, "the cat sat"), (None, "cat"), (8, None), (9, ""), (10, "--"), (11, "THE the\x00the 日本"),
    (12, "été ÉTÉ Été"), (13, "cat " * 5000), (14, "zz9"), *((100 + i, "same text of many") for i in range(60)),
]


@pytest.mark.parametrize("tile", [(2048, 1024, 512), (1, 7, 2)])
def test_ranks_scores_and_ties(spark, monkeypatch, tile):
    for name, value in zip(("TERMS", "DOCUMENTS", "ITEMS"), tile):
        monkeypatch.setattr(lexical_search, name, value)
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in DOCS], "doc_id bigint, text string, item_id int, score int").repartition(3)
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id bigint, text string, doc_id int")
    got = rank_documents(docs, items).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == _ranked(DOCS, ITEMS[1:])
    assert sorted(r["doc_id"] for r in got if r["item_id"] == 6) == list(range(100, 120))


def test_same_as_one_by_one(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = _ranked([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 7)
    assert set(map(tuple, rank_documents(docs, items, k=7).collect())) == want


def test_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "x")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x Y y")], "item_id string, text string")
    assert [(r["rank"], r["doc_id"]) for r in rank_documents(docs, items, k=2).orderBy("rank").collect()] == [(1, "a"), (2, "b")]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert rank_documents(d, i).collect() == []


def test_tiles_stay_exact_and_add_up():
    item, term = np.array([0, 1, 0, 1, 0]), np.array([0, 0, 1, 3, 4])
    weight = np.array([5, 3 * 10**10, 9 * 10**9, 7, 8 * 10**9])
    total = np.zeros((2, 5), dtype=np.int64)
    for lo, hi, dense in tiles(item, term, weight, 2, 5):
        assert dense.sum(axis=1).max() * lexical_search.IMPACT < lexical_search.EXACT
        total[:, lo:hi] += dense.astype(np.int64)
    want = np.zeros_like(total)
    want[item, term] = weight
    assert (total == want).all()

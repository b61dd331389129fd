import pytest

import corpus_pipeline
from tests.llm import brute

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = " ".join(f"word{i % 61} of{i % 17} text{i}" for i in range(120)) + "."
NAMES = [name for name, _ in corpus_pipeline.STAGES]


def _rows():
    rows = [
        (None, "a text without an id. " * 9, "en", "a", 1), (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t\n", "en", "b", 4), (4, "word", None, None, 4),
        (5, PROSE, "en", "a", 9), (5, PROSE, "en", "a", 9), (6, PROSE, "fr", "b", 9), (7, PROSE + " more", "fr", None, 9), (8, "x" * 30_000, "en", "a", 9),
        (9, "line one here.\nline two here.\nline three here.\nown.", "en", "b", 9), (10, "line one here.\nline two here.\nline three here.\nother.", "en", "b", 9),
    ]
    return rows + [(100 + i, f"{PROSE[i * 7 :]} {i}", "en", ("a", "b", None)[i % 3], 1) for i in range(20)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    labels = [(r[0], k % 2, 0) for k, r in enumerate(_rows())]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def _stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.parametrize("name", NAMES)
def test_stage_on_an_empty_table(spark, folder, name):
    assert _stage(name)(spark, spark.createDataFrame([], COLUMNS), folder).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_stage_on_nulls_copies_and_clashing_columns(spark, folder, name):
    rows = _rows()
    clash = [(*r, 1, 2, "x", 3, "y", 0, 1) for r in rows]
    docs = spark.createDataFrame(clash, COLUMNS + ", th bigint, size int, part string, tree int, label string, taken int, times int")
    after = _stage(name)(spark, docs.repartition(4), folder)
    found = after.collect()
    ids = {r[0] for r in rows}
    assert {r["doc_id"] for r in found} <= ids
    if name == "packing":
        assert {r["doc_id"] for r in found} == ids
        return
    assert after.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    texts = {}
    for i, text, *_ in rows:
        texts.setdefault(i, set()).add(text)
    if name != "line dedup":
        assert all(r["text"] in texts[r["doc_id"]] for r in found)
    if name == "line dedup":
        left = {r["doc_id"]: r["text"] for r in found}
        assert left[9].count("\n") == 3 and left[10] == "other." and left[8] == "x" * 30_000
    if name == "near dedup":
        component, _ = brute.components([(r[0], r[1]) for r in rows if r[0] is not None], percent=80, n=5)
        assert {r["doc_id"] for r in found} == {None, *component.values()}

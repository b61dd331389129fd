import pytest
from pyspark.sql import functions as F

from palimpsest.operators import report
from palimpsest.plans.corpus import redact_corpus, redacted_texts
from palimpsest.plans.presets import load_rules
from palimpsest.session import working_folder, written
from palimpsest.sources.text import check_output, read_corpus, read_texts, spread, write_corpus, write_text_files, write_texts


@pytest.fixture()
def corpus(spark):
    rows = [(1, "mail a@b.com\nkeep\nip 10.0.0.1 c@d.org"), (2, "nothing"), (3, "a@b.com")]
    return redact_corpus(spark.createDataFrame(rows, "id int, text string"), "text", ["id"])


def test_summary(corpus):
    assert [tuple(r) for r in report.corpus_summary(corpus).collect()] == [("email", 3), ("ipv4", 1), ("TOTAL", 4)]
    assert report.corpus_summary(corpus.filter("id = 2")).collect() == []


def test_mapping_rows(corpus):
    got = {tuple(r) for r in report.mapping_rows(corpus, ["id"]).collect()}
    assert got == {
        (1, 0, "[TG:EMAIL:1]", "EMAIL", "a@b.com"), (1, 1, "[TG:EMAIL:2]", "EMAIL", "c@d.org"),
        (1, 2, "[TG:IP:1]", "IP", "10.0.0.1"), (3, 0, "[TG:EMAIL:1]", "EMAIL", "a@b.com"),
    }


def test_changed_lines(corpus):
    got = {tuple(r) for r in report.changed_lines(corpus, ["id"], "text").collect()}
    assert got == {
        (1, 1, "mail a@b.com", "mail [TG:EMAIL:1]"),
        (1, 3, "ip 10.0.0.1 c@d.org", "ip [TG:IP:1] [TG:EMAIL:2]"), (3, 1, "a@b.com", "[TG:EMAIL:1]"),
    }
    everything = report.changed_lines(corpus, ["id"], "text", all_lines=True)
    assert everything.count() == 5 and everything.filter("changed").count() == 3


def test_lines_that_disappear_count_as_empty(spark):
    pem = "-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----\nend"
    df = redact_corpus(spark.createDataFrame([(1, pem)], "id int, text string"), "text", ["id"])
    got = [(r["before"], r["after"]) for r in report.changed_lines(df, ["id"], "text").orderBy("line").collect()]
    assert got == [("-----BEGIN PRIVATE KEY-----", "[TG:KEY:1]"), ("x", "end"), ("-----END PRIVATE KEY-----", ""), ("end", "")]


def test_round_trips_and_texts(corpus):
    assert corpus.filter(~report.round_trips(F.col("text"), F.col("redacted"))).count() == 0
    assert {tuple(r) for r in redacted_texts(corpus, ["id"]).select("id", "matches", "values").collect()} == {(1, 3, 3), (2, 0, 0), (3, 1, 1)}


def test_rule_sets_choose_patterns(spark):
    df = spark.createDataFrame([(1, "DE89ABCD1234567 a@b.com")], "id int, text string")
    strict = redact_corpus(df, "text", ["id"], load_rules("training-data")).first()["redacted"]["text"]
    assert strict == "[TG:IBAN:1] [TG:EMAIL:1]"
    assert redact_corpus(df, "text", ["id"], load_rules("desktop")).first()["redacted"]["text"] == "DE89ABCD1234567 [TG:EMAIL:1]"


def test_a_costly_column_is_worked_out_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = redact_corpus(docs, "text", ["doc_id"])
    for result in (report.match_rows(df, ["doc_id"]), report.mapping_rows(df, ["doc_id"]), report.changed_lines(df, ["doc_id"], "text")):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert plan.count("RLIKE -----BEGIN") + plan.count("(?s)-----BEGIN") <= 2, "the redaction appears more than once"
        assert "Exchange" not in plan


def test_only_the_needed_columns_are_read(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = redacted_texts(redact_corpus(docs, "text", ["doc_id"]), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


def test_texts_keep_their_newlines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"x a@b.com\r\n\n")
    (tmp_path / "in/b.txt").write_bytes(b"no newline")
    texts = read_texts(spark, str(tmp_path / "in"))
    assert {r["text"] for r in texts.collect()} == {"x a@b.com\r\n\n", "no newline"}
    one = redacted_texts(redact_corpus(texts.filter(F.col("path").endswith("a.txt")), "text", ["path"]), ["path"]).coalesce(1)
    write_corpus(one, [str(tmp_path / "in")], str(tmp_path / "exact"))
    assert spark.read.parquet(str(tmp_path / "exact")).first()["text"] == "x [TG:EMAIL:1]\r\n\n"
    write_texts(one.withColumn("text", F.concat("text", F.lit("end"))), [str(tmp_path / "in")], str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes() == b"x [TG:EMAIL:1]\r\n\nend\n"


def test_outputs_never_overlap_inputs(spark, tmp_path):
    for bad in ("/data/in", "/data/in/", "file:///data/in/x", "/data", "/data/in/../in"):
        with pytest.raises(ValueError):
            check_output(["/data/in"], bad)
    check_output(["/data/in"], "/data/input2")
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    write_corpus(df, ["/data/in"], str(tmp_path / "o"))
    with pytest.raises(ValueError):
        write_corpus(df, [str(tmp_path / "o")], str(tmp_path / "o"), "overwrite")
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_outputs_are_compared_as_the_file_system_sees_them(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "in")
    given = str(tmp_path / "in")
    monkeypatch.chdir(tmp_path)
    for bad in (f"file:{given}", f"file://{given}/x", str(tmp_path / "link"), str(tmp_path / "link/x"), "/"):
        with pytest.raises(ValueError):
            check_output([given], bad)
    with pytest.raises(ValueError):
        check_output(["s3://bucket/x"], "s3a://bucket/x/y")
    check_output(["s3://bucket/x"], "s3a://other/x")
    working = spark.sparkContext._jvm.java.lang.System.getProperty("user.dir")
    with pytest.raises(ValueError):
        check_output([f"{working}/some"], "some")


def test_text_files_are_byte_exact_and_named(spark, tmp_path):
    rows = [("a/x.txt", "no newline"), ("a/y.txt", "two\r\n\n"), ("z", ""), ("n", None), ("ü.txt", "ü\u2028\0")]
    df = spark.createDataFrame(rows, "name string, text string").repartition(3)
    out = str(tmp_path / "out")
    assert write_text_files(df, [str(tmp_path / "in")], out, "name") == 5
    assert write_text_files(df, [], out, "name") == 5
    found = {str(f.relative_to(out)): f.read_bytes() for f in (tmp_path / "out").rglob("*") if f.is_file() and not f.name.startswith(".")}
    assert found == {k: (v or "").encode() for k, v in rows}
    for bad in ("../x", "/x", "a/../../x", "", None, "a/"):
        with pytest.raises(ValueError):
            write_text_files(spark.createDataFrame([(bad, "t")], "name string, text string"), [], out, "name")
    with pytest.raises(ValueError):
        write_text_files(spark.createDataFrame([("q", "1"), ("q", "2")], "name string, text string"), [], out, "name")
    assert write_text_files(df.limit(0), [], out, "name") == 0


def test_corpus_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc')], "id int, text string")
    df.write.parquet(str(tmp_path / "p"))
    df.write.json(str(tmp_path / "j.jsonl"))
    df.write.orc(str(tmp_path / "o.orc"))
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "c.csv"))
    for name in ("p", "j.jsonl", "o.orc", "c.csv"):
        got = read_corpus(spark, str(tmp_path / name), ["id", "text"], "id int, text string").collect()
        assert [tuple(r) for r in got] == [(1, 'a "q", b\nc')], name


def test_spread_bounds_the_rows_of_a_task(spark):
    rows = spark.range(0, 1000, 1, 4)
    dealt = spread(rows, most=50)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 60 and dealt.distinct().count() == 1000
    assert spread(rows, most=1000).rdd.getNumPartitions() >= 4 and spread(rows.limit(0), most=50).count() == 0


def test_spread_bounds_the_rows_of_a_task_of_uneven_splits(spark):
    uneven = spark.range(0, 1000, 1, 1).union(spark.range(0, 0, 1, 40)).union(spark.range(1000, 1040, 1, 40))
    dealt = spread(uneven, most=50)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 100 and dealt.distinct().count() == 1040


def test_spread_and_working_folder(spark, sf_dir):
    small = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert spread(small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    wide = spark.range(100, numPartitions=50)
    assert spread(wide) is wide
    assert working_folder(spark) != working_folder(spark)
    assert written(small).count() == small.count()

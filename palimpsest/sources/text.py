"""Reading and writing texts without touching a byte of them."""

from __future__ import annotations

import os
import posixpath
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(path, text)``, one row per file with its newlines as they are.

    A file is one scope.
    """
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_corpus(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A Parquet, JSON-lines, ORC or CSV corpus, by file ending (Parquet otherwise)."""
    bare = re.sub(r"\.(gz|bz2|zst)$", "", path)
    if bare.endswith((".jsonl", ".ndjson", ".json")):
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.json(path)
    elif bare.endswith(".csv"):
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.csv(path, header=True, multiLine=True, escape='"')
    elif bare.endswith(".orc"):
        df = spark.read.orc(path)
    else:
        df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    Looking through text is bound by the processor, so a table whose files give
    fewer tasks than that is dealt out first.  A table with enough splits is left
    alone: at scale nothing is moved.

    ``most`` is for tables of narrow rows that texts are worked out of: a split of a file has
    millions of them, far more than a task should work on.  They are dealt out so that a task
    gets ``most`` rows, however many there are and however unevenly they lie in the splits.
    """
    if df.isStreaming:
        return df
    wanted = df.sparkSession.sparkContext.defaultParallelism
    rows = 0 if most is None else df.count()
    if most is not None and rows > most:
        # the number of splits says nothing about the rows of the largest
        return df.repartition(max(wanted, -(-rows // most)))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


# Schemes that name one and the same store.
_ONE_STORE = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "wasb"}


def _location(spark: SparkSession, path: str) -> tuple[str, str, str]:
    """Scheme, authority and absolute path, as the path's file system sees them.

    A relative path gets the working folder, a path without a scheme the default store, a
    link on this machine its target.  A store whose file system is not at hand is
    compared by its text.
    """
    context = spark.sparkContext
    given = context._jvm.org.apache.hadoop.fs.Path(path.strip())
    try:
        given = given.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(given)
    except Py4JJavaError:
        if given.toUri().getScheme() is None:
            raise
    uri = given.toUri()
    scheme, bare = uri.getScheme(), posixpath.normpath(uri.getPath() or "/")
    if scheme == "file":
        bare = os.path.realpath(bare)
    return _ONE_STORE.get(scheme, scheme), uri.getAuthority() or "", bare


def check_output(inputs: list[str], output: str, spark: SparkSession | None = None) -> None:
    """Refuse an output that is, contains or lies inside one of the inputs.

    Spark empties a folder before it overwrites it, so the input would be gone.
    """
    spark = spark or SparkSession.active()
    *store, out = _location(spark, output)
    for path in inputs:
        *other, source = _location(spark, path)
        inside = posixpath.commonpath([out, source]) in (out, source)
        if store == other and inside:
            raise ValueError(f"output {output} overlaps input {path}")


def write_texts(df: DataFrame, inputs: list[str], output: str, text: str = "text") -> None:
    """Write a string column as text files; a text without a final newline gets one.

    :func:`write_text_files` and :func:`write_corpus` keep every text exactly as it is.
    """
    check_output(inputs, output, df.sparkSession)
    df.select(F.regexp_replace(text, r"\n\z", "").alias("value")).write.text(output)


def write_text_files(df: DataFrame, inputs: list[str], output: str, name: str, text: str = "text") -> int:
    """Write each text byte for byte to a file of its own below ``output``; returns how many.

    ``name`` is the file's path below it.  A null or empty name, one that leads out of the
    folder, and a name that two texts have are refused before anything is written.  A null text is
    an empty file.  Tasks write next to the file and rename, so one that is run again
    does no harm.
    """
    spark = df.sparkSession
    check_output(inputs, output, spark)
    named = df.select(F.col(name).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bad = named.groupBy("name").agg(F.count("*").alias("n"))
    leads_out = F.col("name").rlike(r"\A/|(\A|/)\.\.?(/|\z)|/\z") | (F.col("name") == "")
    wrong = bad.filter(F.col("name").isNull() | leads_out | (F.col("n") > 1)).limit(3).collect()
    if wrong:
        raise ValueError(f"names that cannot be used: {[r['name'] for r in wrong]}")
    scheme, authority, bare = _location(spark, output)
    folder = bare if scheme == "file" else f"{scheme}://{authority}{bare}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa_fs.FileSystem.from_uri(folder)
        for batch in batches:
            for own, value in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                path = f"{root}/{own}"
                store.create_dir(posixpath.dirname(path), recursive=True)
                unfinished = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(unfinished, compression=None) as file:
                    file.write(value.encode())
                store.move(unfinished, path)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return named.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_corpus(df: DataFrame, inputs: list[str], output: str, mode: str = "errorifexists") -> None:
    """Write Parquet, texts byte for byte, after making sure that no input is overwritten."""
    check_output(inputs, output, df.sparkSession)
    df.write.mode(mode).parquet(output)

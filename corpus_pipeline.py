"""From documents to packed sequences in five stages.

Every stage takes any table with the columns of ``documents``, others are not looked at: an empty
table gives an empty one, a null text is taken for an empty one, a null source is a source, documents
with a null id are kept where ids tell documents apart, and rows equal in id and text are one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.chosen_path import near_duplicates
from palimpsest.llm.common import SEPARATORS
from palimpsest.llm.compression_classifier import fit, probability
from palimpsest.llm.line_chunks import drop_repeated_chunks
from palimpsest.llm.mixing import mix
from palimpsest.llm.packing import pack
from palimpsest.session import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select(*COLUMNS).filter(probability(model, F.col("text")) >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that stand earlier; a document of which no word is left goes."""
    left = drop_repeated_chunks(docs, carry=("lang", "source"))
    worded = (F.col("n_removed_lines") == 0) | F.col("text").rlike(SEPARATORS.replace("[", "[^").rstrip("+"))
    return left.filter(worded).select(
        "doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("bigint").alias("n_chars")
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every group alike by 80 % of their shingles of five words."""
    dropped = near_duplicates(docs, shingle=5, percent=80).filter("not kept").select("doc_id")
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    times = mix(docs).filter("taken > 0").select("doc_id", "th", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    keyed = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    taken = keyed.join(times.distinct(), keyed["doc_id"].eqNullSafe(times["doc_id"]) & (keyed["th"] == times["th"]))
    return taken.select(*(keyed[c] for c in COLUMNS), F.explode(F.sequence(F.lit(1), "times")).alias("use")).drop("use")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Fitted models and seeded choices are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written before the next reads it."""
    space = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = space.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

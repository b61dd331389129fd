"""Streams of texts, requests and audit entries.

Redaction and classification work on one row, so the batch expressions run on
streams unchanged; this module has the sources and sinks around them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.audit import AUDIT_SCHEMA, entries, recent
from palimpsest.session import settings
from palimpsest.sources.audit_store import STORED

TAIL_INTERVAL = "2 seconds"
TAIL_HISTORY = dt.timedelta(minutes=5)
TAIL_ROWS = 10


def stream_table(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Write what is there to Parquet and stop; the next run goes on after it.

    No batches without data: a stream with a time-to-live would always ask for another.
    """
    with settings(stream.sparkSession, {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        query = (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start(output)
        )
    query.awaitTermination()


def audit_tail(spark: SparkSession, entries_path: str, agent: str = "") -> DataFrame:
    """Entries as they are appended, each once."""
    return entries(spark.readStream.schema(STORED).parquet(entries_path), agent)


def audit_history(audit: DataFrame, agent: str, now: dt.datetime) -> DataFrame:
    """What a tail shows first: the newest entries of the last minutes, oldest first."""
    return recent(audit, agent, now - TAIL_HISTORY, TAIL_ROWS).orderBy("ts", "id")


def watch_audit(tail: DataFrame, show, checkpoint: str) -> StreamingQuery:
    """Call ``show(batch, batch_id)`` for new entries every two seconds."""
    return (
        tail.select([F.col(f.name) for f in AUDIT_SCHEMA.fields])
        .writeStream.foreachBatch(show)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=TAIL_INTERVAL)
        .start()
    )

"""An append-only audit table in Parquet, with export and rotation."""

from __future__ import annotations

import datetime as dt
import uuid
from concurrent.futures import Future
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from palimpsest.operators.audit import AUDIT_SCHEMA, entries, utc_date

# ``appended`` is the moment of appending; ``ts`` is the entry's own.
_COLUMNS = [*AUDIT_SCHEMA.fields, T.StructField("appended", T.TimestampType()), T.StructField("date", T.DateType())]
#: What a file stream of a store's entries has to declare.
STORED = T.StructType([*_COLUMNS, T.StructField("batch", T.StringType())])
_TAKEN = "file string, since timestamp, until timestamp"
_REPLACED = "batch string, into string"


def split_rotation(audit: DataFrame, since: dt.datetime | None, until: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """What a rotation takes out (``since <= ts <= until``) and what it leaves."""
    inside = F.col("ts") <= F.lit(until)
    if since is not None:
        inside = inside & (F.col("ts") >= F.lit(since))
    return audit.filter(inside), audit.filter(~inside)


@dataclass(frozen=True)
class AuditStore:
    """Entries live under ``root/entries``, in a folder for each append, by UTC date.

    Rotation archives a period and notes under ``root/rotations`` which files it
    read; reading leaves out the noted files' entries of that period.  No entry file is
    ever rewritten, so rotating costs as much as its archive, an entry that is appended
    later is kept whatever its time stamp, and a rotation that fails before the note is
    written changes nothing.

    Compaction copies what many appends left into one folder under ``root/compacted`` and
    notes under ``root/compactions`` which appends it stands for; reading leaves these out.
    """

    spark: SparkSession
    root: str

    @property
    def _entries(self) -> str:
        return f"{self.root}/entries"

    @property
    def _rotations(self) -> str:
        return f"{self.root}/rotations"

    @property
    def _compacted(self) -> str:
        return f"{self.root}/compacted"

    @property
    def _compactions(self) -> str:
        return f"{self.root}/compactions"

    def _write(self, new: DataFrame, batch: str) -> None:
        now = F.current_timestamp()
        typed = new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in AUDIT_SCHEMA.fields))
        stamped = typed.withColumn("ts", F.coalesce("ts", now)).withColumn("appended", now)
        self._put(stamped.withColumn("date", utc_date(F.col("ts"))), f"{self._entries}/batch={batch}")

    def _put(self, dated: DataFrame, folder: str) -> None:
        """One shuffle by date keeps the number of files small, and splits a busy date
        over several writers."""
        (
            dated.hint("rebalance", "date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy("date")
            .parquet(folder)
        )

    def _is_whole(self, batch: str) -> bool:
        context = self.spark.sparkContext
        marker = context._jvm.org.apache.hadoop.fs.Path(f"{self._entries}/batch={batch}/_SUCCESS")
        return marker.getFileSystem(context._jsc.hadoopConfiguration()).exists(marker)

    def append(self, new: DataFrame, once: str | None = None) -> None:
        """Add entries; one without a time stamp gets the moment of appending.

        An append with a name is done once: trying again replaces what a failed attempt left, and
        does nothing if it was written whole.
        """
        name = uuid.uuid4().hex if once is None else f"once-{once}"
        if once is None or not self._is_whole(name):
            self._write(new, name)

    def append_missing(self, new: DataFrame) -> None:
        """Add the entries whose ``id`` the store does not have, each once.

        For entries whose id follows from what they are about, so that a job may come over the same
        data again.  Beside other writers of the same ids use a name.
        """
        first = new.dropDuplicates(["id"])
        known = self._if_there(STORED, self._entries)
        if known is not None:
            first = first.join(known.select(F.col("id").alias("known")), F.col("id") == F.col("known"), "left_anti")
        self._write(first, uuid.uuid4().hex)

    def append_stream(self, new: DataFrame, checkpoint: str) -> StreamingQuery:
        """Add the entries of a stream, each once, beside other writers.

        A micro-batch has a folder named after the query and its number: one that is
        tried again replaces what a failed attempt left, and one that was written
        whole is not written a second time.
        """
        started: Future[str] = Future()

        def write(batch: DataFrame, number: int) -> None:
            name = f"{started.result()}-{number}"
            if not self._is_whole(name):
                self._write(batch, name)

        query = (
            new.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        started.set_result(query.id)
        return query

    def _if_there(self, schema: str | T.StructType, path: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _batches(self) -> DataFrame:
        """Entries of all appends and compactions that stand, with the file they are in."""
        # a writer gives the files of all its dates the same name
        file = F.concat_ws("/", "batch", "date", "_metadata.file_name")
        stored = self.spark.read.schema(STORED).parquet(self._entries).withColumn("file", file)
        replaced = self._if_there(_REPLACED, self._compactions)
        if replaced is None:
            return stored
        # One row for each append that was compacted; a copy counts from its note on.
        copies = self.spark.read.schema(STORED).parquet(self._compacted).withColumn("file", file)
        into = replaced.select(F.col("into").alias("batch")).distinct()
        return stored.unionByName(copies.join(into, "batch", "left_semi")).join(replaced.select("batch"), "batch", "left_anti")

    def _current(self) -> DataFrame:
        current = self._batches()
        taken = self._if_there(_TAKEN, self._rotations)
        if taken is None:
            return current
        noted = taken.select(F.col("file").alias("noted"), "since", "until")
        inside = (F.col("ts") <= F.col("until")) & (F.col("since").isNull() | (F.col("ts") >= F.col("since")))
        return current.join(noted, (F.col("file") == F.col("noted")) & inside, "left_anti")

    def compact(self) -> int:
        """Copy all entries that are there into one folder, in few files a date; return how many appends it stands for.

        Entries that were rotated out are not copied.  Nothing is deleted, so readers and tails of
        the appends go on, an append that is tried again is still known, and a compaction
        that fails before its note changes nothing.  Not beside a rotation: what that takes out after the copy
        was made would come back with it.
        """
        batches = self._batches().select("batch").distinct()
        names = [r["batch"] for r in batches.collect()]
        into = f"compact-{uuid.uuid4().hex}"
        # What is appended from here on is no part of it.
        listed = F.broadcast(self.spark.createDataFrame([(n,) for n in names], "batch string"))
        copied = self._current().join(listed, "batch", "left_semi").select(*(f.name for f in _COLUMNS))
        self._put(copied, f"{self._compacted}/batch={into}")
        note = self.spark.createDataFrame([(n, into) for n in names], _REPLACED)
        note.coalesce(1).write.mode("append").parquet(self._compactions)
        return len(names)

    def read(self) -> DataFrame:
        """All entries that have not been rotated out."""
        return self._current().select(*(f.name for f in _COLUMNS))

    def _export(self, found: DataFrame, path: str) -> int:
        seen = Observation()
        (
            found.select(*(f.name for f in _COLUMNS if f.name != "date"))
            .observe(seen, F.count(F.lit(1)).alias("n"))
            .write.option("timeZone", "UTC")
            .json(path)
        )
        return seen.get["n"]

    def export(self, path: str, since: dt.datetime | None = None, until: dt.datetime | None = None) -> int:
        """Write all matching entries as JSON lines, uncapped, in UTC; return how many."""
        return self._export(entries(self._current(), since=since, until=until), path)

    def rotate(self, path: str, since: dt.datetime | None = None, now: dt.datetime | None = None) -> int:
        """Export the entries from ``since`` up to now and take exactly those out.

        Older entries, and whatever is appended after this began, stay.
        """
        until = now or dt.datetime.now()
        # Both jobs go over the files that were listed when this was made.
        found = entries(self._current(), since=since, until=until)
        count = self._export(found, path)
        bounds = (F.lit(since).cast("timestamp").alias("since"), F.lit(until).alias("until"))
        found.select("file").distinct().select("file", *bounds).write.mode("append").parquet(self._rotations)
        return count

"""Sessions, scoped settings and intermediate tables in the shared working folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
#: A finished step's shuffle files go when its table is written, not when the driver next collects garbage.
_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_local: dict[str, str] = {}


def local_session(cpus: int | str = "*", name: str = "palimpsest") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs run inside; afterwards they are as they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def working_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Only a session that names none, as in tests, gets one on this machine.
    """
    shared = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(_CHECKPOINT_DIR)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_DIR} to a folder all executors can reach")
        application = spark.sparkContext.applicationId
        if application not in _local:
            _local[application] = tempfile.mkdtemp(prefix="run-")
        shared = _local[application]
    return f"{shared.rstrip('/')}/palimpsest-{uuid.uuid4().hex}"


class Workspace:
    """Intermediate tables of one computation, removed together.

    As a context manager it removes them at the end of the block, also after an error;
    the result must be written inside.  Otherwise they go with ``close()`` or, at the
    latest, when Python ends with the session still open.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._folder = working_folder(spark)
        self._tables = 0
        atexit.register(self.close)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def written(self, df: DataFrame) -> DataFrame:
        """``df`` as a table in the folder: computed once, read as often as needed,
        and still there if executors are lost."""
        self._tables += 1
        path = f"{self._folder}/{self._tables}"
        with settings(self._spark, _STEP):
            df.write.option("compression", "zstd").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Remove the tables; a second call does nothing."""
        atexit.unregister(self.close)
        context = self._spark.sparkContext
        if context._jsc is None or not self._tables:
            return
        path = context._jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        self._tables = 0


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in a workspace of its own, which goes when the session ends."""
    return Workspace(df.sparkSession).written(df)

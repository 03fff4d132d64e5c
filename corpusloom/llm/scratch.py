"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir)."""

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that a task hands to Python at once, unless the session says otherwise.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches between Spark and Python by bytes: ten thousand rows, Spark's own bound, may be long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(key, None):
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or else a folder in the warehouse, which executors share as well."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"


#: Paths of the tables written, by application, in order.
_written: dict[str, list[str]] = {}


def _paths(spark: SparkSession) -> list[str]:
    return _written.setdefault(spark.sparkContext.applicationId, [])


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there, and an executor
    that is lost costs only its own running tasks. The files stay until `release` or `clean`."""
    path = f"{shared_dir(df.sparkSession)}/corpusloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths(df.sparkSession).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """How many tables have been written so far, for `release`."""
    return len(_paths(spark))


def release(spark: SparkSession, since: int) -> None:
    """Delete the tables written since a mark but for the last, which must not need them any more."""
    paths = _paths(spark)
    for path in paths[since:-1]:
        _delete(spark, path)
    del paths[since:-1]


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() has written and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in [p for p in _paths(spark) if any(f"/{p.rpartition('/')[2]}/" in f for f in df.inputFiles())]:
            _delete(spark, path)
            _paths(spark).remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings of the session, named with _ for a dot, that hold within."""
    keys = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidy(spark: SparkSession):
    """Within, a query's shuffle files are deleted when it ends, instead of when the driver's collector finds them unused. For queries
    whose result is written."""
    return settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true")


def clean(spark: SparkSession) -> None:
    """Delete every intermediate table in the shared folder; call it once results are written."""
    _delete(spark, f"{shared_dir(spark)}/corpusloom")
    _paths(spark).clear()

"""The folder that driver and executors share, for what is written and read again.

Paths stay until they are released or the process ends, also where the session was stopped before.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local: list[tempfile.TemporaryDirectory] = []
_made: dict[str, object] = {}  # paths of this process that are not yet released, and Hadoop's settings for them
_watched: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("docloom_scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session on one machine may leave it unset, as in tests; a temporary
    folder is used then."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.TemporaryDirectory(prefix="docloom-"))
            atexit.register(_local[0].cleanup)
        base = _local[0].name
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    if not _made:
        atexit.unregister(_release_rest)
        atexit.register(_release_rest)
    path = f"{shared_dir(spark)}/docloom/{uuid.uuid4().hex}-{tag}"
    _made[path] = spark._jsc.hadoopConfiguration()
    for paths in _watched.get():
        paths.append(path)
    return path


@contextlib.contextmanager
def watched() -> Iterator[list[str]]:
    """Lists the paths that this thread makes inside the block, for `released`:
    with watched() as made: df = operator(...); df.write...; released(spark, *made)"""
    paths: list[str] = []
    token = _watched.set((*_watched.get(), paths))
    try:
        yield paths
    finally:
        _watched.reset(token)


def _delete(jvm, path: str, conf) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def released(spark: SparkSession, *paths: str) -> None:
    """Deletes what was written. No DataFrame that reads it may be used any more."""
    for path in paths:
        if (conf := _made.pop(path, None)) is not None:
            _delete(spark._jvm, path, conf)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a part of what was written, such as one folder of a partitioned table."""
    _delete(spark._jvm, path, spark._jsc.hadoopConfiguration())


def _release_rest() -> None:
    """At the end of the process; the JVM still answers when the session has been stopped."""
    from pyspark import SparkContext

    for path, conf in list(_made.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(SparkContext._jvm, path, conf)
    _made.clear()


#: Removes the shuffle files of a query when it ends, instead of when the driver's JVM next collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside the block leaves no shuffle files; nothing reads them again. The session's setting comes back."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def written_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """`written`, and the path to release."""
    path = new_path(df.sparkSession, tag)
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and a lost
    executor costs no recomputation of what stands before."""
    return written_at(df, tag)[0]

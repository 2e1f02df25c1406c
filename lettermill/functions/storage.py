"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local applications, and the paths that each application was given.
_local: dict[str, str] = {}
_given: dict[str, list[str]] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The paths of the steps that the current thread is in, the innermost last.
_steps = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent, a temporary folder serves in local mode only.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="lettermill-")
    return _local[app]


def new_path(spark: SparkSession, name: str = "lettermill") -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given.setdefault(spark.sparkContext.applicationId, []).append(path)
    if getattr(_steps, "open", None):
        _steps.open[-1].append(path)
    return path


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs meanwhile go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: a lineage cut that outlives executors."""
    path = new_path(df.sparkSession)
    with _shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        path = hadoop(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> int:
    """Delete what this application wrote to the shared folder, once its results are stored elsewhere; the number of paths."""
    paths = _given.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


@contextmanager
def steps_to_one_table(spark: SparkSession, keep: int = 1) -> Iterator[None]:
    """Around steps whose last cut, or last `keep` cuts, hold all that later steps read: the tables before are deleted at the end.

    If a step fails, all of them are. Only tables that this thread wrote within the steps are deleted.
    """
    paths: list[str] = []
    _steps.open = [*getattr(_steps, "open", []), paths]
    done = False
    try:
        yield
        done = True
    finally:
        _steps.open = _steps.open[:-1]
        kept = paths[-keep:] if done else []
        gone = [p for p in paths if p not in kept]
        _delete(spark, gone)
        given = _given.get(spark.sparkContext.applicationId, [])
        given[:] = [p for p in given if p not in set(gone)]
        if _steps.open:
            _steps.open[-1].extend(kept)

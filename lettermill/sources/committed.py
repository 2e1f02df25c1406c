"""Tables that grow by commits: all parts of a commit are seen, or none is, and a commit is made once.

The parts of a commit are written to folders of their own, one for each table; then one entry that
names these folders is put into the log by a rename, which fails if the entry is there. Readers read
the folders that entries name, so parts of a write that failed, or of one that came second, are never
seen. Tables that must not share a folder (redacted texts and the original values) share a log. The
driver reads one line a commit. Renames within a folder of the log have to be atomic, as they are on
the file systems of clusters.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    """(file system, path) by Hadoop's interface, which every store that Spark reads has."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _entry(log: str, key: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.=-]*", key):
        raise ValueError(f"a commit's key is made of letters, digits, dots, hyphens and equals signs: {key!r}")
    return f"{log.rstrip('/')}/{key}.json"


def is_committed(spark: SparkSession, log: str, key: str) -> bool:
    fs, at = _path(spark, _entry(log, key))
    return fs.exists(at)


def commit(tables: dict[str, DataFrame], log: str, key: str, format: str = "parquet") -> bool:
    """Write each DataFrame below its path and make them visible together; False if the key was committed before.

    A key that is there already costs one look and writes nothing, so a batch can be replayed.
    """
    spark = next(iter(tables.values())).sparkSession
    if is_committed(spark, log, key):
        return False
    folders = {path.rstrip("/"): f"{path.rstrip('/')}/{key}-{uuid.uuid4().hex}" for path in tables}
    if len(folders) < len(tables):
        raise ValueError("tables of a commit need folders of their own")
    for path, df in tables.items():
        df.write.format(format).save(folders[path.rstrip("/")])
    line = json.dumps({"key": key, "format": format, "folders": list(folders.values())})
    fs, hidden = _path(spark, f"{log.rstrip('/')}/.{key}-{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(bytearray(line.encode()))
    out.close()
    try:
        done = not is_committed(spark, log, key) and fs.rename(hidden, _path(spark, _entry(log, key))[1])
    except Py4JJavaError:
        done = False  # some stores report a taken name by an exception
    if not done:
        fs.delete(hidden, False)
    return bool(done)


def commits(spark: SparkSession, log: str) -> DataFrame:
    """(key, format, folders): one row a commit."""
    schema = "key string, format string, folders array<string>"
    fs, at = _path(spark, log)
    return spark.read.schema(schema).json(log) if fs.exists(at) else spark.createDataFrame([], schema)


def read(spark: SparkSession, log: str, path: str, schema) -> DataFrame:
    """The rows that were committed to path; no rows before the first commit."""
    root = path.rstrip("/") + "/"
    found = [(r.format, f) for r in commits(spark, log).orderBy("key").collect() for f in r.folders if f.startswith(root)]
    if not found:
        return spark.createDataFrame([], schema)
    (format,) = {f for f, _ in found}
    return spark.read.format(format).schema(schema).load([f for _, f in found])

"""Working tables in the folder that the driver and all executors share.

Iterative operators cut their lineage by writing Parquet here. The folder is
``spark.checkpoint.dir`` of the session; only where that is unset (tests on one
machine) a temporary folder is made, and only for a local master: executors elsewhere
could not read it. Tables are deleted by ``drop_table``, or when the driver exits.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver exits."""
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}/{name}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def work_table(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read back: recomputation starts from the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[table] = path
    return table


def drop_table(table: DataFrame) -> None:
    """Delete a working table that no later step reads; a frame that isn't one is left alone."""
    path = _tables.pop(table, None)
    if path is not None:
        drop_path(table.sparkSession, path.rsplit("/", 1)[0])


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint where it has at most ``max_rows`` rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one path through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path.rsplit("/", 1)[0])
        except Exception:  # the session may be gone at exit; the folder is temporary anyway
            return

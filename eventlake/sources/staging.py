"""Intermediate tables in the folder all executors share, and their removal.

The folder is ``spark.checkpoint.dir``.  Only a local session may go without it; elsewhere a machine's own folder would be
invisible to the other machines, so its absence is an error.  What nobody released is removed when the driver ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Writer options for tables that hold whole files as payloads.  A reader's batch has up to 4,096 rows but never crosses a row group, and the buffer of a
#: text column doubles as it grows.  A row group's size counts compressed bytes, of which Snappy makes at most about 21 times as many: 2 MB keep a batch
#: below some 40 MB of text, where one of the usual 128 MB held all payloads of a file.  Sizes are checked from the tenth row on.
WIDE = {"parquet.block.size": 2 << 20, "parquet.page.size.row.check.min": 10}

_made: dict[str, SparkSession] = {}
_owner = os.getpid()
_local: dict[int, str] = {}


def shared_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local.setdefault(os.getpid(), "file://" + tempfile.mkdtemp(prefix="eventlake-"))
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one."""
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends in files all executors see.  ``options``: the writer's."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.options(**options).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._eventlake_folder = path
    return found


def release(*frames: DataFrame) -> None:
    """Removes the folders of materialized frames that nothing will read any more."""
    for df in frames:
        path = getattr(df, "_eventlake_folder", None)
        if path:
            remove_folder(df.sparkSession, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    _made.pop(path, None)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _sweep() -> None:
    if os.getpid() != _owner:
        return
    for path, spark in list(_made.items()):
        try:
            jvm = spark._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone; leftovers are then the shared folder's owner's to sweep
            return

"""Lineage cuts that survive the loss of an executor.

Intermediate results that are read more than once, or whose row numbering must not change on a retry, are written as
Parquet below the folder all executors share (``spark.checkpoint.dir``) and read back.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[object, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return str(known.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="lorebase-")
    spark.sparkContext.setCheckpointDir(own)
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*staged: DataFrame) -> None:
    """Delete what ``stage`` wrote for these; for intermediate results that nothing still to be run reads."""
    paths = {df.staged_at for df in staged}
    for spark, path in [x for x in _written if x[1] in paths]:
        _written.remove((spark, path))
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def drop_staged() -> None:
    """Delete what ``stage`` wrote in this session; runs at exit and may be called between jobs."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            pass


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

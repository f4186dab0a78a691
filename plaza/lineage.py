"""Cutting lineage through tables written to the folder all executors share.

``spark.checkpoint.dir`` names that folder.  Where it is unset the session's
checkpoint directory counts, and with a local master (tests on one machine) a
temporary directory of this process; a cluster without either is an error, as
each of its machines would write to a disk of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_LOCAL: list[str] = []
_SCRATCH: list[str] = []


def _clean() -> None:
    """At the end of the driver: scratch tables that were not dropped before."""
    spark = SparkSession.getActiveSession()
    for path in list(_SCRATCH):
        try:
            if spark is not None:
                drop_path(spark, path)
            elif path.startswith("file://"):
                shutil.rmtree(path.removeprefix("file://"), True)
        except Exception:  # the cluster may be gone already
            return


atexit.register(_clean)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or one temporary folder where none is named and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="plaza-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return "file://" + _LOCAL[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/plaza/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    if path in _SCRATCH:
        _SCRATCH.remove(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> int:
    """Delete all scratch tables made so far, once no result that reads them is needed any more; their number.

    Long sessions call it between jobs, so that the shared folder does not fill.
    """
    paths, _SCRATCH[:] = list(_SCRATCH), []
    for path in paths:
        drop_path(spark, path)
    return len(paths)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder; the table as read back, and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` with its lineage cut: later work reads a written table."""
    return written(df, name)[0]


def counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, str, dict]:
    """``written``, with aggregates of the table, which read only the columns they need."""
    table, path = written(df, name)
    return table, path, table.agg(*[c.alias(n) for n, c in metrics.items()]).first().asDict()

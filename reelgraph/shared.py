"""The folder that driver and executors share, and scratch tables in it."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Collection

from pyspark.sql import SparkSession

LOCAL = "file:///tmp/reelgraph-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, set for checkpoints too.

    Where it is unset, a session of one machine uses a folder of its own; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = LOCAL
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, remembered until it is dropped."""
    path = posixpath.join(shared_dir(spark), f"reelgraph-{what}-{uuid.uuid4().hex}")
    _SCRATCH.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's own file system layer."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _SCRATCH:
        _SCRATCH.remove(path)


def drop_scratch(spark: SparkSession, keep: Collection[str] = ()) -> None:
    """Drop the scratch tables of this session, once the results that read them have been used."""
    for path in [p for p in _SCRATCH if p not in keep]:
        drop_path(spark, path)

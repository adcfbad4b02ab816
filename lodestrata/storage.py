"""Where the library writes intermediate files: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a temporary folder if driver and tasks are one process (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
    return root if ":/" in root else "file://" + root


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared root; nothing is created."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, uri: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, uri: str) -> bool:
    p, fs = _path(spark, uri)
    return fs.exists(p)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Move within one file system; false if the target is there."""
    p, fs = _path(spark, source)
    q, _ = _path(spark, target)
    return not fs.exists(q) and fs.rename(p, q)


def remove(spark: SparkSession, uri: str) -> None:
    p, fs = _path(spark, uri)
    fs.delete(p, True)


def listed(spark: SparkSession, uri: str) -> list[str]:
    p, fs = _path(spark, uri)
    return sorted(str(s.getPath()) for s in fs.listStatus(p))


def frozen(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable checkpoint in the shared folder: what was computed once is read again, also after executors are lost."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)

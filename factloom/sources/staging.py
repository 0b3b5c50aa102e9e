"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process, by application.
_WRITTEN: dict[str, list[str]] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Without either, a session on one machine gets a temporary folder; on a cluster that is an error,
    since executors could not read what others write.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="factloom-"))
        root = context.getCheckpointDir()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(context.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: worked out once, and later plans do not carry its expressions."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> int:
    """Delete what this session has staged; tables made from it can't be read any more."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)

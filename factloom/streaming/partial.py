"""Partial means of a running job, written once a batch and taken up after a crash."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions.numbers import rounded

Publish = Callable[[int, DataFrame], None]


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose sums are complete, in order."""
    where, store = _folder(spark, folder)
    if not store.exists(where):
        return []
    names = [s.getPath().getName() for s in store.listStatus(where)]
    numbers = [int(n[6:]) for n in names if re.fullmatch(r"batch=\d+", n)]
    return sorted(n for n in numbers if store.exists(_folder(spark, f"{folder}/batch={n}/_SUCCESS")[0]))


def _state(spark: SparkSession, folder: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/batch={number}")


def apply(batch: DataFrame, number: int, folder: str, by: Sequence[str], values: Sequence[str]) -> bool:
    """Add a batch to the sums; False if they hold it already, so a repeated batch changes nothing.

    A version is a folder a batch number, complete when its mark is there; one that a crash has cut short
    is written anew.  The version before the last stays, in case the last is cut short.
    """
    spark = batch.sparkSession
    done = versions(spark, folder)
    if done and done[-1] >= number:
        return False
    sums = batch.groupBy(*by).agg(F.count(F.lit(1)).alias("processed"), *(F.sum(F.col(v).cast("double")).alias(f"sum_{v}") for v in values), *(F.count(v).alias(f"n_{v}") for v in values))
    if done:
        both = _state(spark, folder, done[-1]).unionByName(sums)
        sums = both.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums.columns if c not in by))
    sums.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    for old in done[:-1]:
        where, store = _folder(spark, f"{folder}/batch={old}")
        store.delete(where, True)
    return True


def means(spark: SparkSession, folder: str, by: Sequence[str], values: Sequence[str]) -> DataFrame | None:
    """(by, processed, mean of each value) as of the last complete batch; None before the first."""
    done = versions(spark, folder)
    if not done:
        return None
    return _state(spark, folder, done[-1]).select(*by, "processed", *(rounded(F.try_divide(f"sum_{v}", f"n_{v}")).alias(v) for v in values))


def write(stream: DataFrame, checkpoint: str, by: Sequence[str], values: Sequence[str], publish: Publish | None = None, **trigger) -> StreamingQuery:
    """Keep the partial means of a stream by group; the sums lie in the query's own checkpoint folder, under ``means``.

    ``publish`` gets the number and the means after each batch, also after one that is repeated, and
    must be harmless to repeat.  ``trigger`` is handed on; without one, the query runs over what there is.
    """
    folder = f"{checkpoint.rstrip('/')}/means"

    def each(batch: DataFrame, number: int) -> None:
        apply(batch, number, folder, by, values)
        if publish is not None:
            publish(number, means(batch.sparkSession, folder, by, values))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Helpers that the training-data operators share: shared folders, file access, batches, worker tables."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that an Arrow worker takes at once; a longer text is taken by itself.
SLICE_BYTES = 2 << 20
#: Folders that this process has written through ``saved``, by session.
_WRITTEN: dict[str, list[str]] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Without either, a session on one machine gets a temporary folder; on a cluster that is an error,
    since executors could not read what others write.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="factloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI under ``checkpoint_root``."""
    path = f"{checkpoint_root(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._saved_in = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the folder of a ``saved`` table that no later plan reads."""
    _delete(df.sparkSession, df._saved_in)
    _WRITTEN[df.sparkSession.sparkContext.applicationId].remove(df._saved_in)


def clean_up(spark: SparkSession) -> int:
    """Delete all folders that this session's operators have written; their results can't be read any more."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI or plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def write_atomically(uri: str, parts: Iterator[bytes]) -> None:
    """Write a file under a name of its own, then move it: a repeated or speculative task is harmless."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
    fs.move(temporary, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a worker holds at once stays bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, where each begins and, last, the end); nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def by_bytes(batches: Iterator, column: int | None = None, limit: int = SLICE_BYTES) -> Iterator:
    """Smaller batches (or arrays, where ``column`` is None) whose texts hold at most ``limit`` bytes, or a single row."""
    for batch in batches:
        _, at = text_bytes(batch if column is None else batch.column(column))
        first, n = 0, len(at) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def gathered(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of ``values`` one after the other, where each begins and, last, the end)."""
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    kind = np.int32 if max(len(values), int(ends[-1])) < 2**31 else np.int64
    at = np.repeat((begins - ends[:-1]).astype(kind), lengths)
    at += np.arange(ends[-1], dtype=kind)
    return values[at], ends


_HELD: dict[str, dict] = {}


def only(owner: str) -> dict:
    """The tables that the operator ``owner`` keeps in this worker process; those of other operators are let go.

    Workers are reused by later stages, so without this they would hold the tables of all operators.
    """
    if list(_HELD) != [owner]:
        kept = _HELD.pop(owner, {})
        _HELD.clear()
        _HELD[owner] = kept
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # no such call outside glibc
            pass
    return _HELD[owner]

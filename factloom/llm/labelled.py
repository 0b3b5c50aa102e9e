"""Folds and bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0))


def sampled(ids: DataFrame, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` ids, those of the least hashes: the same ones however the table is cut."""
    return ids.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(rows)


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(columns of ids, text) of the documents named, one row each; ``ids`` is bounded by its sample, so it is broadcast.

    Of rows with one id the text of the least hash counts, so there are never more rows than ids.
    """
    named = ids.withColumnRenamed(id_col, "its_id")
    columns = [c for c in named.columns if c != "its_id"]
    chosen = docs.select(F.col(id_col).alias("an_id"), F.coalesce(F.col(text_col), F.lit("")).alias("its_text"))
    found = chosen.join(F.broadcast(named), F.col("an_id") == F.col("its_id"))
    return found.groupBy("an_id", *columns).agg(F.min_by("its_text", F.struct(F.xxhash64("its_text"), "its_text")).alias("text")).select(*columns, "text")

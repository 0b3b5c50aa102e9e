"""Relational operators on run tables: upserts, limits, merges, breakdowns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.evidence import first_rows


def latest(df: DataFrame, key: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Last writer wins: one row a key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    row = F.max_by(F.struct(*rest), F.struct(*seq)).alias("_row")
    return df.groupBy(*key).agg(row).select(*key, "_row.*").select(*df.columns)


def per_group_limit(df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_rows(df, n, by, order)


def head_after_groups(df: DataFrame, per_group: int, total: int, by: str, order: Sequence[str]) -> DataFrame:
    """First rows of each group, then the head of all, groups in order."""
    return per_group_limit(df, per_group, [by], [F.col(c) for c in order]).orderBy(by, *order).limit(total)


def category_filter(df: DataFrame, column: str, names: Sequence[str], collapse: bool = True) -> DataFrame:
    lowered = F.lower(column)
    return df.where((F.trim(F.regexp_replace(lowered, r"\s+", " ")) if collapse else lowered).isin(*names))


def breakdown(df: DataFrame, outer: str, inner: str, *aggregates: Column) -> DataFrame:
    """Aggregates by ``outer`` and by both, in one pass; ``inner`` is null in the totals."""
    return df.groupingSets([[F.col(outer)], [F.col(outer), F.col(inner)]], outer, inner).agg(*aggregates, F.grouping(inner).cast("int").alias("is_total"))


def merged(left: DataFrame, right: DataFrame, keys: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Full outer join; ``fill`` columns of both sides are coalesced, left first."""
    other = right.withColumnsRenamed({c: f"_{c}" for c in fill})
    joined = left.join(other, list(keys), "full_outer")
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in fill}).drop(*(f"_{c}" for c in fill))


def stale_gaps(df: DataFrame, by: str, ts: str, seconds: int, tie: str) -> DataFrame:
    """Rows that no row of the same group follows within ``seconds``."""
    following = F.lead(ts).over(Window.partitionBy(by).orderBy(ts, tie))
    gap = following.cast("timestamp").cast("long") - F.col(ts).cast("timestamp").cast("long")
    return df.withColumn("gap_seconds", gap).where(F.col("gap_seconds") > seconds)


def merged_by_priority(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Rows of several tables by key; of equal keys the last table's row stays."""
    numbered = reduce(DataFrame.unionByName, (df.withColumn("_nth", F.lit(i)) for i, df in enumerate(parts)))
    return latest(numbered, key, ["_nth"]).drop("_nth")

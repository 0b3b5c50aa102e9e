"""Exact top-k inner products by norm buckets with length or coordinate pruning.

Vectors are dealt to buckets of similar length, the longest first.  Buckets are searched in rounds
of 1, 2, 4, ... buckets.  After each round a query's k-th best score so far is its bound, which rises
from round to round; a bucket is skipped by a query when even its longest vector, pointing the
query's way, cannot reach the bound, and queries that no further bucket can serve drop out.
Otherwise the bound over both lengths is a local cosine threshold: where it is low, vectors are cut by
length (a prefix of the bucket in order of length); where it is high, by coordinates (the interval
that the query's largest coordinates leave).  What remains is verified by integer products.

There are at most ``BUCKETS`` buckets, so their edges stay a short list; a large bucket is split by
hash.  Queries are dealt to at most ``CLASSES`` classes by the length of vector that they still need,
so that short vectors are sent only to the few queries that need them, and then to blocks by hash.
Bucket split and query block form a task's group; both hold some ``NUMBERS`` numbers.

Cases: vectors that are null or hold null or non-finite components take no part, nor do null ids, nor
vectors of 2**31 or more in length after scaling, whose products may not fit 64 bits; vectors meet
only those of their own dimension; repeated ids are rows of their own, as queries and as candidates,
and a query meets all rows but itself; fewer than k candidates give fewer rows; ties go to the smaller
id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.shared import saved

SCALE = 1024
#: Buckets of different length and classes of queries at most; numbers of a bucket split or query block, on average.
BUCKETS, CLASSES, NUMBERS = 256, 32, 1 << 19
#: Longer vectors, after scaling, take no part.
LONGEST = 2.0**31
#: Local cosine thresholds from here on are pruned by coordinates, lower ones by length.
COSINE = 0.3
#: Coordinates that a query prunes by.
FOCUS = 4

_LONGS = "query_row long, query_id long, row long, vec_id long, score long"


def scaled(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, vec, length, size): floor(scale * x) as longs; rows that take no part are gone."""
    x = F.transform(vec_col, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    raw = F.transform(vec_col, lambda v: F.lit(float(scale)) * v.cast("double"))
    bad = F.exists(raw, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= LONGEST))
    df = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad)
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: v.cast("long")).alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    return df.select("vec_id", "vec", norm.alias("length"), F.size("vec").alias("size")).where(F.col("length") < LONGEST)


def _exact(values: np.ndarray, top: int) -> np.ndarray:
    """Integers as doubles where every product sum is exact in them (BLAS multiplies doubles only), else longs."""
    return values.astype(np.float64) if float(top) ** 2 * max(1, values.shape[1]) < 2**53 else values


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def search_bucket(rows_of: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and the places in the bucket and scores of its k best rows that reach its bound."""
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    rows_of, ids, vectors, lengths = rows_of[order], ids[order], vectors[order], lengths[order]
    top = int(max(np.abs(vectors).max(initial=0), np.abs(queries).max(initial=0)))
    exact, exact_queries = _exact(vectors, top), _exact(queries, top)
    unit = vectors / np.maximum(lengths, 1e-300)[:, None]
    columns = np.ascontiguousarray(unit.T)
    slack = 1e-9
    for place, (query_row, query, bound) in enumerate(zip(query_rows.tolist(), queries, bounds.tolist(), strict=True)):
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        rows = np.arange(len(ids))
        if np.isfinite(bound) and bound > 0:
            reach = length * lengths[0] if len(lengths) else 0.0
            if reach * (1 + slack) < bound:
                continue
            cosine = min(1.0, bound / max(reach, 1e-300))
            # Length: a row needs |row| >= bound / |query|.
            rows = rows[: int(np.searchsorted(-lengths, -bound / max(length, 1e-300) * (1 - slack), "right"))]
            if cosine >= COSINE:
                direction = query / max(length, 1e-300)
                for at in np.argsort(-np.abs(direction))[:FOCUS]:
                    q = float(direction[at])
                    middle, half = q * cosine, np.sqrt(max(0.0, (1 - cosine**2) * (1 - q**2)))
                    x = columns[at][rows]
                    # Beyond the interval's end on the query's own side the cosine bound still can hold up to 1.
                    low = -1.0 if q < -cosine else middle - half
                    high = 1.0 if q > cosine else middle + half
                    rows = rows[(x >= low - slack) & (x <= high + slack)]
        rows = rows[rows_of[rows] != query_row]
        if not len(rows):
            continue
        scores = exact[rows] @ exact_queries[place]
        if np.isfinite(bound):
            near = scores >= bound
            rows, scores = rows[near], scores[near]
        best = _best(scores, ids[rows], k)
        yield place, order[rows[best]], scores[best].astype(np.int64)


def _search(bucket: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    if len(bucket) and len(queries):
        rows, ids = bucket["row"].to_numpy(np.int64), bucket["vec_id"].to_numpy(np.int64)
        vectors, asked = (np.stack(c.to_numpy()).astype(np.int64) for c in (bucket["vec"], queries["query"]))
        query_rows, query_ids = queries["query_row"].to_numpy(np.int64), queries["query_id"].to_numpy(np.int64)
        if vectors.shape[1]:
            for place, found, scores in search_bucket(rows, ids, vectors, query_rows, asked, queries["bound"].to_numpy(np.float64), k):
                for column, x in zip(out, (np.full(len(found), query_rows[place]), np.full(len(found), query_ids[place]), rows[found], ids[found], scores), strict=True):
                    column.append(x)
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    return pd.DataFrame(dict(zip([x.split()[0] for x in _LONGS.split(", ")], columns, strict=True)))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _edges(df: DataFrame, column: str, parts: int) -> list[float]:
    """At most ``parts`` - 1 values that cut ``column`` into parts of similar size."""
    if parts <= 1:
        return []
    return sorted(set(df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.25 / parts)))


def _above(edges: list[float], column: str):
    """How many of the edges lie above a value: part 0 has the largest values."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e > F.col(column))) if edges else F.lit(0)


def top_k(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, bucket: int | None = None, block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each row for which ``is_query`` holds.

    ``is_query`` is a condition on vec_id.  Scores are integers: products of floor(scale * x).
    ``bucket`` and ``block`` are the rows of a bucket split and of a query block; by default they
    follow the dimension.
    """
    spark = df.sparkSession
    rows = saved(scaled(df, id_col, vec_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, widest = rows.agg(F.count(F.lit(1)), F.max("size")).first()
    each = max(256, NUMBERS // max(1, widest or 1))
    bucket, block = bucket or each, block or each
    buckets = min(BUCKETS, max(1, -(-n // bucket)))
    rows = rows.withColumn("bucket", _above(_edges(rows, "length", buckets), "length").cast("int"))
    # At most BUCKETS rows.
    sizes = sorted(tuple(r) for r in rows.groupBy("bucket").agg(F.max("length"), F.ceil(F.count(F.lit(1)) / bucket).cast("int")).collect())
    queries = rows.where(is_query).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), F.col("length").alias("query_length"), "size")
    best, first, width = None, 0, 1
    while first < len(sizes):
        some = sizes[first : first + width]
        first, width = first + width, 2 * width
        bounds = spark.createDataFrame([], "query_row long, bound long") if best is None else best.where(F.col("rank") == k).select("query_row", F.col("score").alias("bound"))
        asked = queries.join(bounds, "query_row", "left")
        reaches = lambda longest: F.col("bound").isNull() | (F.col("query_length") * longest * (1 + 1e-9) >= F.col("bound"))
        asked = saved(asked.where(reaches(F.lit(some[0][1]))).withColumn("need", F.when(F.col("query_length") > 0, F.col("bound") / F.col("query_length"))).withColumn("need", F.coalesce("need", F.lit(float("-inf")))), "asked")
        left = asked.count()
        if not left:
            break
        # Few queries without a bound would spoil the quantiles of those with one; they are a class of their own.
        bounded = asked.where("bound IS NOT NULL")
        classes = _above(_edges(bounded, "need", min(CLASSES, -(-left // block))), "need")
        hashes = -(-left // (block * min(CLASSES, -(-left // block))))
        targets = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(longest).alias("longest"), F.lit(s).alias("splits")) for b, longest, s in some))
        sent = asked.withColumns({"class": F.when(F.col("bound").isNull(), -1).otherwise(classes).cast("int"), "block": F.pmod(F.xxhash64("query_row", F.lit(1)), F.lit(hashes)).cast("int")})
        sent = sent.withColumn("target", F.explode(F.filter(targets, lambda t: reaches(t["longest"])))).withColumn("bound", F.coalesce(F.col("bound").cast("double"), F.lit(float("-inf"))))
        wanted = sent.select("target.bucket", F.col("class").alias("class")).distinct()  # at most BUCKETS * (CLASSES + 1) rows
        asks = sent.select("target.bucket", "class", "block", "size", F.explode(F.sequence(F.lit(0), F.col("target.splits") - 1)).alias("split"), "query_row", "query_id", "query", "bound")
        splits = F.element_at(F.create_map(*(F.lit(x) for b, _, s in some for x in (b, s))), F.col("bucket"))
        held = rows.where(F.col("bucket").between(some[0][0], some[-1][0])).join(F.broadcast(wanted), "bucket")
        held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))))
        held = held.select("bucket", "class", "block", "size", F.pmod(F.xxhash64("row"), splits).cast("int").alias("split"), "row", "vec_id", "vec")
        # The dimension is part of a group's name: a query meets vectors of its own dimension only.
        key = ["bucket", "split", "class", "block", "size"]
        found = held.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(lambda b, q: _search(b, q, k), _LONGS)
        best = saved(_ranked(found if best is None else best.drop("rank").unionByName(found), k), "best")
    if best is None:
        best = spark.createDataFrame([], f"{_LONGS}, rank int")
    return best.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * p.e[i])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id AND len(q.e) = len(p.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

"""Scores: token F1, set precision and recall, deltas, summaries, bootstrap intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.functions.numbers import rounded
from factloom.functions.text import tokens
from factloom.sources.staging import staged


def f1(tp: Column, predicted: Column, gold: Column) -> Column:
    """F1 from counts; nothing on both sides is 1, nothing on one is 0."""
    return F.when((predicted == 0) & (gold == 0), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * tp, predicted + gold), F.lit(0.0)))


def precision(tp: Column, predicted: Column, gold: Column) -> Column:
    return F.when((predicted == 0) & (gold == 0), 1.0).otherwise(F.coalesce(F.try_divide(tp.cast("double"), predicted), F.lit(0.0)))


def recall(tp: Column, predicted: Column, gold: Column) -> Column:
    return F.when((predicted == 0) & (gold == 0), 1.0).otherwise(F.coalesce(F.try_divide(tp.cast("double"), gold), F.lit(0.0)))


def _numbered(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the tokens of a text, each with how many times it has come so far, so that they make a set."""
    held, firsts = f"{name}_held", f"{name}_firsts"
    df = df.withColumn(held, F.array_sort(tokens(F.col(text))))
    n = F.size(held)
    at = lambda i: F.get(held, i)
    new = lambda i: (i == 0) | (at(i) != at(i - 1))
    df = df.withColumn(firsts, F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), new)))
    ends = F.concat(F.slice(firsts, 2, F.size(firsts)), F.array(n))
    run = lambda first, end: F.transform(F.sequence(F.lit(1), end - first), lambda k: F.concat_ws(" ", at(first), k.cast("string")))
    none = F.array().cast("array<string>")
    return df.withColumn(name, F.when(n > 0, F.flatten(F.zip_with(firsts, ends, run))).otherwise(none)).drop(held, firsts)


def token_overlap(df: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """(keys, common, n_left, n_right): multiset overlap of the tokens of two texts, row by row."""
    df = df.select(*keys, F.col(left).alias("_left_text"), F.col(right).alias("_right_text"))
    df = _numbered(_numbered(df, "_left_text", "_l"), "_right_text", "_r")
    size = lambda x: F.size(x).cast("long")
    return df.select(*keys, size(F.array_intersect("_l", "_r")).alias("common"), size("_l").alias("n_left"), size("_r").alias("n_right"))


def token_f1(df: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """(keys, token_f1): 0 if a side has no tokens."""
    found = token_overlap(df, keys, left, right)
    return found.select(*keys, F.coalesce(F.try_divide(2.0 * F.col("common"), F.col("n_left") + F.col("n_right")), F.lit(0.0)).alias("token_f1"))


def set_scores(predicted: DataFrame, gold: DataFrame, items: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, tp, n_predicted, n_gold, precision, recall, f1) of the distinct tuples ``items``, by ``keys``."""
    mark = lambda df, p, g: df.select(*keys, *items).distinct().withColumns({"p": F.lit(p), "g": F.lit(g)})
    both = mark(predicted, 1, 0).unionByName(mark(gold, 0, 1)).groupBy(*keys, *items).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    tp, n_p, n_g = F.col("tp"), F.col("n_predicted"), F.col("n_gold")
    found = both.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("p") * F.col("g")), F.lit(0)).alias("tp"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_predicted"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_gold")
    )
    return found.withColumns({"precision": precision(tp, n_p, n_g), "recall": recall(tp, n_p, n_g), "f1": f1(tp, n_p, n_g)})


def item(*fields: Column) -> Column:
    """A tuple as one text, by which arrays of tuples are compared; nulls are equal to each other only."""
    return F.concat_ws("\x00", *(F.coalesce(F.concat(F.lit("="), f), F.lit("")) for f in fields))


def with_array_scores(df: DataFrame, sides: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """``df`` with name_precision, name_recall and name_f1 of the distinct elements of two arrays (predicted, gold) that stand on one row.

    Arrays and counts are columns of their own, so each is worked out once a row.
    """
    none = F.array().cast("array<string>")
    columns = df.columns
    df = df.withColumns({f"_{name}_{c}": F.array_distinct(F.coalesce(x, none)) for name, pair in sides.items() for c, x in zip("pg", pair, strict=True)})
    both = lambda name: F.array_intersect(f"_{name}_p", f"_{name}_g")
    df = df.withColumns({f"_{name}_{c}": x for name in sides for c, x in (("tp", F.size(both(name))), ("np", F.size(f"_{name}_p")), ("ng", F.size(f"_{name}_g")))})
    counts = lambda name: [F.col(f"_{name}_{c}") for c in ("tp", "np", "ng")]
    scores = {"precision": precision, "recall": recall, "f1": f1}
    return df.select(*columns, *(score(*counts(name)).alias(f"{name}_{c}") for name in sides for c, score in scores.items()))


def delta_matrix(scores: DataFrame, name: str = "baseline", value: str = "score") -> DataFrame:
    """Difference of each pair of a small table of named scores (one row a baseline)."""
    right = scores.select(F.col(name).alias("rhs"), F.col(value).alias("_r"))
    return scores.select(F.col(name).alias("lhs"), F.col(value).alias("_l")).crossJoin(right).select("lhs", "rhs", (F.col("_l") - F.col("_r")).alias("delta"))


def delta_maps(matrix: DataFrame) -> DataFrame:
    """(lhs, deltas): a delta matrix with a map a baseline."""
    return matrix.groupBy("lhs").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rhs", "delta")))).alias("deltas"))


def delta_vs(scores: DataFrame, anchor: str, name: str = "baseline", values: Sequence[str] = ("score",)) -> DataFrame:
    """Each row's values less those of the anchor row; nulls stay null."""
    base = scores.where(F.col(name) == anchor).select(*(F.col(v).alias(f"_{v}") for v in values))
    return scores.crossJoin(F.broadcast(base)).select(name, *((F.col(v) - F.col(f"_{v}")).alias(f"{v}_delta") for v in values))


def accuracy(df: DataFrame, predicted: str, gold: str, *keys: str) -> DataFrame:
    """Share of gold rows predicted right; a missing prediction is wrong."""
    right = F.coalesce((F.col(predicted) == F.col(gold)).cast("double"), F.lit(0.0))
    return df.where(F.col(gold).isNotNull()).groupBy(*keys).agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def running_mean(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean over the processed prefix of each group."""
    found = prefixes(df, by, order, {"_sum": F.col(value).cast("double"), "_n": F.col(value).isNotNull().cast("long")})
    return found.withColumn("running_mean", F.try_divide("_sum", "_n")).drop("_sum", "_n")


def checkpoints(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], every: int = 10) -> DataFrame:
    """(by, processed, total, mean of each value so far) after each ``every`` rows of a group, and at its end."""
    sums = {f"_sum_{v}": F.col(v).cast("double") for v in values} | {f"_n_{v}": F.col(v).isNotNull().cast("long") for v in values}
    found = prefixes(df, by, order, {"processed": F.lit(1).cast("long"), **sums})
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    found = found.join(total, list(by)).where((F.col("processed") % every == 0) | (F.col("processed") == F.col("total")))
    return found.select(*by, "processed", "total", *(rounded(F.try_divide(f"_sum_{v}", f"_n_{v}")).alias(v) for v in values))


def prefixes(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """``df`` with running sums over each group in order of ``order``; rows of equal order may change places.

    Rows are dealt by range of group and order, so that a large group fills many tasks; each part
    sums its own rows and adds what the parts before it hold, of which there is one row a group and part.
    """
    dealt = df.withColumns({f"_of{name}": x for name, x in sums.items()}).repartitionByRange(*by, *order)
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*by, "_part").agg(*(F.sum(f"_of{name}").alias(f"_to{name}") for name in sums))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_its"), *(F.sum(f"_to{name}").over(before).alias(f"_to{name}") for name in sums))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by), F.col("_part") == F.col("_its"))
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = lambda x: F.coalesce(x, F.lit(0))
    found = dealt.join(offsets, same)
    return found.select(*df.columns, *((zero(F.sum(f"_of{name}").over(within)) + zero(F.col(f"_to{name}"))).alias(name) for name in sums))


#: Rows of a part of a group that draws for itself.
PART_ROWS = 4_096
#: Draws that a task makes at once.
_DRAWS = 1 << 21
#: From so many rows a value on, a part counts draws by value.
_REPEATED = 8
#: By how many times a part may be larger where values repeat.
_WIDEST = 64


def drawn_from(part: int, n: int, resamples: int, seed: Sequence[int], part_rows: int = PART_ROWS) -> np.ndarray:
    """How many of the n draws of each resample fall to a part of ``part_rows`` of the n rows.

    The rows are halved until the part is left; each half gets a binomial share of the draws, from a
    generator seeded by the group and the half's bounds, so all parts of a group agree without meeting.
    """
    low, high = 0, -(-n // part_rows)
    counts = np.full(resamples, n, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        total, left = min(high * part_rows, n) - low * part_rows, (middle - low) * part_rows
        to_left = np.random.default_rng([*seed, low, high]).binomial(counts, left / total)
        if part < middle:
            counts, high = to_left, middle
        else:
            counts, low = counts - to_left, middle
    return counts


def _sums(values: np.ndarray, weights: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The sum of ``counts[b]`` draws for each resample b, from distinct ``values`` that stand for ``weights`` rows each."""
    rows, out = int(weights.sum()), np.zeros(len(counts))
    if len(values) * _REPEATED <= rows:  # how often each value is drawn, not one draw after the other
        step = max(1, _DRAWS // len(values))
        for at in range(0, len(counts), step):
            out[at : at + step] = rng.multinomial(counts[at : at + step], weights / rows) @ values
        return out
    every, step = np.repeat(values, weights), max(1, _DRAWS // max(1, int(counts.max())))
    for at in range(0, len(counts), step):
        some = counts[at : at + step]
        drawn = every[rng.integers(0, rows, int(some.sum()))]
        ends = np.concatenate([[0.0], np.cumsum(drawn)])
        upto = np.cumsum(some)
        out[at : at + step] = ends[upto] - ends[upto - some]
    return out


def bootstrap(df: DataFrame, value: str, id_col: str, keys: Sequence[str], resamples: int = 2000, seed: int = 7, part_rows: int = PART_ROWS) -> DataFrame:
    """(keys, mean, low, high, n): percentile interval of the mean, from ``resamples`` draws with replacement.

    Equal values of a group are counted first; rows are numbered in order of value and cut into parts of
    ``part_rows``, or of so many times that as values repeat (``_WIDEST`` times at most).  Each part works out how many
    draws of every resample fall to it and draws them from its own rows; only sums, one a part and
    resample, are shuffled, and the result does not depend on partitions.  Rows with null values are
    left out; one row is its own interval.  Rows need no ids: those of equal value are alike (``id_col`` is not read).
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counted = known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    rows = staged(prefixes(counted, keys, ["_v"], {"_end": F.col("_c")}).select(*keys, "_v", "_c", (F.col("_end") - F.col("_c")).alias("_at")), "numbered")
    totals = rows.groupBy(*keys).agg(F.sum("_c").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"), F.count(F.lit(1)).alias("_values"))
    by = {f"_key{i}": F.col(k) for i, k in enumerate(keys)}
    size = part_rows * F.least(F.lit(_WIDEST), F.ceil(F.col("n") / F.col("_values")))
    sizes = totals.select(*(c.alias(name) for name, c in by.items()), F.col("n").alias("_n"), size.cast("long").alias("_size"))
    totals = totals.drop("_values")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(name)) for name, k in zip(by, keys, strict=True)), F.lit(True))
    # A value that fills several parts gives each its share.
    first, last = F.floor(F.col("_at") / F.col("_size")), F.floor((F.col("_at") + F.col("_c") - 1) / F.col("_size"))
    dealt = rows.join(sizes, same).withColumn("_part", F.explode(F.sequence(first, last)))
    held = F.least(F.col("_at") + F.col("_c"), (F.col("_part") + 1) * F.col("_size")) - F.greatest(F.col("_at"), F.col("_part") * F.col("_size"))
    dealt = dealt.select(*keys, "_v", held.alias("_c"), "_n", "_size", F.xxhash64(F.lit(seed), *keys).alias("_group"), "_part")

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_v")
        of = rows.iloc[0]
        group, part, n, size = (int(of[c]) for c in ("_group", "_part", "_n", "_size"))
        group &= 2**63 - 1
        counts = drawn_from(part, n, resamples, (seed, group), size)
        sums = _sums(rows["_v"].to_numpy(), rows["_c"].to_numpy(), counts, np.random.default_rng((seed, group, part)))
        return pd.DataFrame({"_b": np.arange(resamples), "_sum": sums}).assign(**{k: of[k] for k in keys})[[*keys, "_b", "_sum"]]

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("_b", T.LongType()), T.StructField("_sum", T.DoubleType())])
    # A part is few bytes and much work: with a number given, parts are not put together into one task by their size.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = dealt.repartition(tasks, *keys, "_part").groupBy(*keys, "_part").applyInPandas(draw, schema)
    means = sums.groupBy(*keys, "_b").agg(F.sum("_sum").alias("_m"))
    ranked = means.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_m", "_b")) - 1)  # ``resamples`` rows a group
    low, high = int(0.025 * resamples), min(resamples - 1, int(0.975 * resamples))
    ends = ranked.groupBy(*keys).agg(F.max(F.when(F.col("_r") == low, F.col("_m"))).alias("_low"), F.max(F.when(F.col("_r") == high, F.col("_m"))).alias("_high"))
    ends = ends.withColumnsRenamed(dict(zip(keys, by, strict=True)))
    end = lambda c: F.when(F.col("n") == 1, F.col("mean")).otherwise(F.col(c) / F.col("n"))
    return totals.join(ends, same).select(*keys, "mean", end("_low").alias("low"), end("_high").alias("high"), "n")

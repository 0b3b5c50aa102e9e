"""The bootstrap: draws by part against plain draws, and the registered queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import registry
from factloom.operators import metrics
from factloom.plans import reports


def plain(values, resamples, rng):
    """(mean of the resampled means, their deviation, the interval's ends)."""
    means = np.sort([rng.choice(values, len(values)).mean() for _ in range(resamples)])
    return means.mean(), means.std(), means[int(0.025 * resamples)], means[int(0.975 * resamples)]


def test_parts_share_the_draws_like_a_multinomial():
    n, size, resamples = 1_000, 64, 4_000
    counts = np.array([metrics.drawn_from(p, n, resamples, (7, 5), size) for p in range(-(-n // size))])
    assert (counts.sum(axis=0) == n).all() and (counts >= 0).all()
    share = np.array([min(size, n - p * size) / n for p in range(len(counts))])
    assert np.allclose(counts.mean(axis=1), n * share, atol=4 * np.sqrt(n * share / resamples))
    assert np.allclose(counts.var(axis=1), n * share * (1 - share), rtol=0.12)
    # Of two parts, the counts are as dependent as they should be.
    assert np.cov(counts[0], counts[9])[0, 1] == pytest.approx(-n * share[0] * share[9], rel=0.5)
    assert (metrics.drawn_from(0, 40, 10, (1,), 64) == 40).all()


@pytest.mark.parametrize("part_rows", [16, 4096])
def test_interval_is_that_of_plain_draws(spark, part_rows):
    rng = np.random.default_rng(4)
    values = rng.exponential(10, 300)
    rows = [(i, "a", float(v)) for i, v in enumerate(values)] + [(0, "one", 5.0), (1, "one", None), (0, "none", None), (0, None, 2.0), (1, None, 4.0)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    got = {r.k: r for r in metrics.bootstrap(df, "v", "id", ["k"], part_rows=part_rows).collect()}
    assert got.keys() == {"a", "one", None}
    assert (got["one"].low, got["one"].high, got["one"].n) == (5.0, 5.0, 1) and got[None].n == 2
    _, deviation, low, high = plain(values, 20_000, rng)
    assert got["a"].mean == pytest.approx(values.mean())
    assert got["a"].low == pytest.approx(low, abs=0.15 * deviation) and got["a"].high == pytest.approx(high, abs=0.15 * deviation)


def test_interval_does_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("k"), F.sin("id").alias("v"))
    ends = [sorted(map(tuple, metrics.bootstrap(d, "v", "id", ["k"], 200, part_rows=50).collect())) for d in (df.coalesce(1), df.repartition(7, "v"))]
    assert ends[0] == ends[1]


def test_summary_by_scope(spark):
    rows = [(b, str(i), "C" + str(i % 2), i / 4 if i % 5 else None, 1.0) for b in ("x", "y") for i in range(12)]
    df = spark.createDataFrame(rows, "baseline string, doc_id string, category string, m1 double, m2 double")
    got = {(r.scope, r.baseline, r.metric): r for r in reports.metric_summary(df, ["m1", "m2"], 300).collect()}
    assert len(got) == 3 * 2 * 2
    known = [i / 4 for i in range(12) if i % 5]
    top = got["overall", "x", "m1"]
    assert top.n == len(known) and top.mean == pytest.approx(np.mean(known)) and top.low < top.mean < top.high
    assert got["C1", "y", "m1"].n == len([i for i in range(1, 12, 2) if i % 5])
    flat = got["C0", "y", "m2"]
    assert (flat.mean, flat.low, flat.high) == (1.0, 1.0, 1.0)


def test_bootstrap_ci_takes_all_rows(spark, tmp_path):
    rows = [(i, "AB"[i % 2], float(i)) for i in range(25)] + [(90, "C", 5.0), (91, "C", None)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_mktsegment: r for r in registry.queries()["bootstrap_ci"](spark, str(tmp_path)).collect()}
    assert {k: r.n for k, r in got.items()} == {"A": 13, "B": 12, "C": 1}

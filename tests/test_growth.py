"""What fails only on larger tables: joins that broadcast what grows, keys that read as something else."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from factloom import catalog_runs
from factloom.operators import evidence, metrics
from factloom.plans import experiment, reports
from factloom.sources import examples, staging

GRAPH = "graph_with_profile_selection_only"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _artifacts(spark):
    rows = [(GRAPH, "1", [("A", "T")]), (GRAPH, "2", [("Revenue", "FinancialMetric")])]
    art = spark.createDataFrame(rows, "baseline string, example_id string, e array<struct<name: string, entity_type: string>>")
    answer = F.struct(F.lit("Financials").alias("category"), F.lit("Did revenue change").alias("question"), F.lit("It did").alias("ground_truth_answer"))
    text = art.select(F.to_json(F.struct("baseline", "example_id", F.struct(F.col("e").alias("entities")).alias("extraction"), answer.alias("answer"))).alias("value"))
    return text.select(F.from_json("value", reports.ARTIFACT).alias("a")).select("a.*")


def test_gold_and_artifacts_are_not_broadcast(spark):
    gold = spark.createDataFrame([("1", "c"), ("3", "c")], "example_id string, category string")
    missing = reports.manual_gold_missing(_artifacts(spark), gold)
    assert "BroadcastHashJoin" not in _plan(missing)
    assert [tuple(r) for r in missing.collect()] == [(GRAPH, "3")]


def test_amounts_of_no_supplier_read_as_years(spark, tmp_path):
    spark.range(1980, 2100).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {int(r.example_id): r.n_entities for r in catalog_runs.gold_resolution(spark, str(tmp_path)).collect()}
    assert got == {k: 2 if k % 5 == 0 else (2, 5, 1)[k % 3] for k in range(1980, 2100)}


def test_metric_rows_broadcast_nothing_and_read_artifacts_once(spark):
    answers = spark.createDataFrame([(GRAPH, "2", "Financials", 0.5), ("reference_only_baseline", "2", "Financials", 0.25)], "baseline string, doc_id string, category string, token_f1 double")
    found = reports.metric_rows(answers, _artifacts(spark))
    plan = _plan(found)
    assert "BroadcastHashJoin" not in plan and plan.split("== Initial Plan ==")[-1].count("FileScan parquet") == 1
    got = {(r.baseline, r.doc_id): (r.answer_quality_delta, r.ontology_constrained_extraction_f1) for r in found.collect()}
    assert got == {(GRAPH, "1"): (None, 0.5), (GRAPH, "2"): (0.25, 1.0), ("reference_only_baseline", "2"): (0.0, None)}


def test_draws_by_value_are_those_by_row():
    rng = np.random.default_rng(3)
    values, weights, counts = np.array([0.0, 0.25, 2.0]), np.array([900, 300, 100]), np.full(20_000, 1_300)
    by_value = metrics._sums(values, weights, counts, rng)
    by_row = rng.choice(np.repeat(values, weights), (4_000, 1_300)).sum(axis=1)
    assert abs(by_value.mean() - by_row.mean()) < 0.1 * by_row.std() and abs(by_value.std() / by_row.std() - 1) < 0.05


def test_bootstrap_draws_from_values_not_from_rows(spark):
    """Its parts are as many as values fill, however often these repeat; the interval is the normal one."""
    df = spark.range(200_000).select("id", F.when(F.col("id") < 1_000, F.col("id") / 512).otherwise(F.col("id") % 5 / 4).alias("v"), F.lit("a").alias("k"))
    mean, deviation = df.agg(F.avg("v"), F.stddev_pop("v")).first()
    got = metrics.bootstrap(df, "v", "id", ["k"]).first()
    half = 1.96 * deviation / 200_000**0.5
    assert (got.n, round(got["mean"], 9)) == (200_000, round(mean, 9))
    assert abs(got.low - (mean - half)) < 0.15 * half and abs(got.high - (mean + half)) < 0.15 * half


def test_an_experiment_writes_no_texts_and_moves_them_once(spark):
    noise = random.Random(1)
    rows = [(str(i), "What dividend policy?", False, "Shareholder  Return", [f"Acme Inc. declared a dividend. {noise.randbytes(50_000).hex()}"], "The dividend.", "x") for i in range(4)]
    given = examples.load_examples(spark.createDataFrame(rows, "_id string, text string, reasoning boolean, category string, references array<string>, answer string, type string"), per_category=None)
    before = len(staging._WRITTEN.get(spark.sparkContext.applicationId, []))
    found = experiment.run(given)
    paths = [p.removeprefix("file:") for p in staging._WRITTEN[spark.sparkContext.applicationId][before:]]
    written = sum(os.path.getsize(os.path.join(at, name)) for path in paths for at, _, names in os.walk(path) for name in names)
    assert len(paths) > 3 and written < 4 * 50_000  # less than the texts of one copy
    rows = found.where("baseline LIKE 'full%'").select("answer", "token_f1", F.size("triples").alias("n"))
    plan = _plan(rows).split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 2 and "BroadcastHashJoin" not in plan  # the examples, and what the graphs say of them
    got = rows.collect()
    assert len(got) == 4 and all(r.n == 1 and r.answer.startswith("Graph-grounded evidence indicates: Acme Inc. declared dividend tied to Dividend. Supporting reference text: Acme Inc. declared a dividend.") for r in got)


def test_snippets_found_in_the_row_are_those_joined(spark):
    texts = spark.createDataFrame([("1", ["Bo Ray chairs the Board. Nobody else. The board met.", "Ann Lee is Chair of the Board. Bo Ray left."]), ("2", [])], "doc string, references array<string>")
    rows = [("g1", "1", "a", "Bo Ray", "chairs", "Board"), ("g1", "1", "b", "Ann Lee", "holds_role", "Chair"), ("g2", "1", "a", "Bo Ray", "chairs", "Board"), ("g3", "2", "a", "Bo Ray", "chairs", "Board")]
    edges = spark.createDataFrame(rows, "graph_id string, doc string, edge_id string, source_name string, relation_type string, target_name string")
    used = edges.withColumns({"source_type": F.lit("T"), "target_type": F.lit("T"), "confidence": F.lit(0.5), "ord": F.col("edge_id")})
    joined = evidence.bundle(used, evidence.snippets(edges, evidence.sentence_rows(texts, ["doc"]), "doc", 2, ["graph_id"]), ["graph_id", "doc"])
    bare = evidence.bundle(used, None, ["graph_id", "doc"]).groupBy("doc").agg(F.collect_list(F.struct("graph_id", "triples")).alias("graphs"))
    in_row = evidence.exploded_with_snippets(texts.join(bare, "doc"), "graphs", limit=2)
    listed = lambda df: {(r.graph_id, t.edge_id): t.provenance_snippets for r in df.collect() for t in r.triples}
    assert listed(in_row) == listed(joined) and listed(in_row)["g1", "b"] == ["Bo Ray chairs the Board.", "Ann Lee is Chair of the Board."] and listed(in_row)["g3", "a"] == []

"""Tables that change by commits, and aliases as a table."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.sources import commits, sinks

NODE, EDGE = "graph_id string, node_id string, v int", "graph_id string, edge_id string, source_node_id string, target_node_id string, v int"


def files_read(df):
    return len(df.inputFiles())


def test_readers_see_whole_commits(spark, tmp_path):
    root = str(tmp_path / "g")
    nodes, edges = spark.createDataFrame([("g", "a", 1), ("g", "b", 1)], NODE), spark.createDataFrame([("g", "1", "a", "b", 1)], EDGE)
    first = sinks.write_graph(nodes, edges, root, 1, 4)
    # A writer that has written the nodes of its commit, and not more, is not seen.
    nodes.withColumn("v", F.lit(99)).withColumn("seq", F.lit(9).cast("long")).write.parquet(f"{root}/data/nodes/commit=broken")
    n, e = sinks.read_graph(spark, root)
    assert {(r.node_id, r.v) for r in n.collect()} == {("a", 1), ("b", 1)} and e.count() == 1
    sinks.write_graph(nodes.where("node_id = 'a'").withColumn("v", F.lit(2)), edges.limit(0), root, 2, 4)
    assert {(r.node_id, r.v) for r in sinks.read_graph(spark, root)[0].collect()} == {("a", 2), ("b", 1)}
    assert {(r.node_id, r.v) for r in sinks.read_graph(spark, root, first)[0].collect()} == {("a", 1), ("b", 1)}
    assert commits.vacuum(spark, root, keep=5) == 1 and sinks.read_graph(spark, root)[1].count() == 1


def test_a_global_graph_fills_all_buckets(spark, tmp_path):
    root = str(tmp_path / "g")
    ids = F.concat(F.lit("n"), "id")
    nodes = spark.range(200).select(F.lit("g").alias("graph_id"), ids.alias("node_id"), F.lit(1).alias("v"))
    edges = spark.range(200).select(F.lit("g").alias("graph_id"), F.col("id").cast("string").alias("edge_id"), ids.alias("source_node_id"), ids.alias("target_node_id"), F.lit(1).alias("v"))
    sinks.write_graph(nodes, edges, root, 1, 8)
    assert [files_read(commits.rows(spark, root, t)) for t in ("nodes", "edges")] == [8, 8]


def test_compaction_reads_a_file_a_bucket_and_keeps_what_comes_meanwhile(spark, tmp_path):
    root = str(tmp_path / "r")
    row = lambda i, status: spark.createDataFrame([(f"run{i}", status)], "run_id string, status string").coalesce(1)
    for i in range(12):
        sinks.upsert(row(i % 3, f"s{i}"), root, "experiment_runs", i)
    plan = commits.rows(spark, root, "experiment_runs", sinks._stored("experiment_runs"))
    assert files_read(plan) == 12
    before, publish = {r.run_id: r.status for r in sinks.current(spark, root, "experiment_runs").collect()}, commits._publish

    def late(*args):
        """Another writer commits while the compaction has not been published."""
        commits._publish = publish
        sinks.upsert(row(1, "late"), root, "experiment_runs", 99)
        return publish(*args)

    commits._publish = late
    try:
        commits.compact(spark, root, {"experiment_runs": ("run_id",)}, 2, {"experiment_runs": sinks._stored("experiment_runs")})
    finally:
        commits._publish = publish
    assert before == {"run0": "s9", "run1": "s10", "run2": "s11"}
    assert {r.run_id: r.status for r in sinks.current(spark, root, "experiment_runs").collect()} == before | {"run1": "late"}
    assert files_read(commits.rows(spark, root, "experiment_runs", sinks._stored("experiment_runs"))) <= 3
    assert commits.vacuum(spark, root, keep=1) == 12
    assert sinks.current(spark, root, "experiment_runs").count() == 3


def test_run_tables_compact(spark, tmp_path):
    root = str(tmp_path / "r")
    sinks.create(spark, root)
    rows = spark.createDataFrame([(f"r{i % 2}", "b", f"d{i}") for i in range(20)], "run_id string, baseline string, doc_id string")
    for seq in range(3):
        sinks.upsert(rows, root, "graph_ingestion", seq)
    sinks.compact(spark, root, 2)
    assert sinks.current(spark, root, "graph_ingestion").count() == 20
    one = sinks.current(spark, root, "graph_ingestion", run_id="r1")
    assert one.count() == 10 and "PartitionFilters: [isnotnull(run_id" in one._jdf.queryExecution().toString()


@pytest.mark.parametrize("broadcast_rows", [10, 0])
def test_aliases_from_a_table(spark, broadcast_rows):
    names = [" ACME Corp ", "acme corp"] * 50 + ["Other"] * 40 + [None, "x", "Beta", "beta"]
    mentions = spark.createDataFrame([(i, n, "k") for i, n in enumerate(names)], "i int, name string, id string")
    aliases = spark.createDataFrame([("Acme Corp", "acme"), ("acme corp ", "acme_2"), ("beta", "b"), (None, "n"), ("unused", "u")], "alias string, id string")
    got = {r.i: (r.name, r.id, r._alias_name) for r in graph.with_aliases(mentions, "name", aliases, broadcast_rows).collect()}
    want = {"acme corp": "acme", "beta": "b"}
    assert got == {i: (n, "k", want.get((n or "").strip().lower())) for i, n in enumerate(names)}


def test_a_graph_by_alias_table_is_that_by_map(spark):
    entities = spark.createDataFrame([("g", 0, "d", "p", i, n, "T", 0.5) for i, n in enumerate(["Acme Corp", "ACME", "Beta Inc", "!!"])], "graph_id string, doc_ord int, doc_id string, profile string, pos int, name string, entity_type string, confidence double")
    relations = spark.createDataFrame([("g", 0, "d", "p", 0, "acme", "r", "Beta Inc", 0.5)], "graph_id string, doc_ord int, doc_id string, profile string, pos int, source_name string, relation_type string, target_name string, confidence double")
    known = {"acme": "acme_corp", "beta inc": "beta"}
    table = spark.createDataFrame(list(known.items()), "alias string, id string")
    rows = lambda pair: [sorted(map(str, df.select(sorted(df.columns)).collect())) for df in pair]
    assert rows(graph.build(entities, relations, aliases=table)) == rows(graph.build(entities, relations, aliases=known))
    assert rows(graph.node_sets(entities, relations, aliases=table)) == rows(graph.node_sets(entities, relations, aliases=known))

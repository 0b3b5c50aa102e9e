"""Sinks: Parquet by category, run metadata tables with last-writer-wins reads, graphs, artifacts, CSV."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.operators.tables import category_filter, latest
from factloom.sources import commits
from factloom.sources.examples import CATEGORIES, require

# The run metadata tables, their columns and keys; decisions and ingestion are kept for each baseline.
KEYS = {
    "documents": ("doc_id",),
    "experiment_runs": ("run_id",),
    "profile_decisions": ("run_id", "baseline", "doc_id"),
    "graph_ingestion": ("run_id", "baseline", "doc_id"),
    "question_answers": ("run_id", "question_id"),
    "artifacts": ("artifact_id",),
}
SCHEMAS = {
    "documents": "doc_id string, source_dataset string, category string, sample_type string, input_text string, reference_json string, created_at string",
    "experiment_runs": "run_id string, run_type string, agent_framework string, model_name string, dataset_path string, ontology_version string, started_at string, finished_at string, status string, notes string, created_at string",
    "profile_decisions": "run_id string, baseline string, doc_id string, selected_profile string, candidate_profiles_json string, confidence double, mapping_policy string, extension_policy string, rationale_json string, created_at string",
    "graph_ingestion": "run_id string, baseline string, doc_id string, node_count int, edge_count int, graph_namespace string, graph_uri string, quality_summary_json string, created_at string",
    "question_answers": "run_id string, question_id string, doc_id string, category string, query_template string, selected_profile string, answer_text string, answer_confidence double, supporting_edges_json string, evaluation_json string, created_at string",
    "artifacts": "artifact_id string, run_id string, doc_id string, question_id string, artifact_type string, artifact_path string, metadata_json string, created_at string",
}
# End of fixed values.


def ingest(source: DataFrame, path: str) -> DataFrame:
    """Write the kept categories, one partition each; counts by category come back."""
    kept = category_filter(require(source), "category", CATEGORIES, collapse=False)
    kept.write.mode("overwrite").partitionBy("category").parquet(path)
    written = source.sparkSession.read.parquet(path)
    return written.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy("category")


def conforming(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns of a run table: those it lacks are null, others are dropped."""
    schema = _schema(name)
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def _schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def _of_run(name: str) -> list[str]:
    """Tables that hold many runs are kept in a folder a run, so that a run's rows are read alone."""
    return ["run_id"] if name != "experiment_runs" and "run_id" in _schema(name).fieldNames() else []


def _stored(name: str) -> StructType:
    return _schema(name).add("seq", "long")


def create(spark: SparkSession, root: str) -> None:
    """All run tables, without rows, in one commit."""
    commits.commit(spark, root, {name: spark.createDataFrame([], _stored(name)) for name in SCHEMAS}, {name: _of_run(name) for name in SCHEMAS})


def upsert(df: DataFrame, root: str, name: str, seq: int) -> None:
    """Append rows under a sequence number; readers take the latest row of each key."""
    commits.commit(df.sparkSession, root, {name: conforming(df, name).withColumn("seq", F.lit(seq).cast("long"))}, {name: _of_run(name)})


def current(spark: SparkSession, root: str, name: str, key: tuple[str, ...] | None = None, run_id: str | None = None) -> DataFrame:
    """The latest row of each key, of one run or of all."""
    table = commits.rows(spark, root, name, _stored(name))
    table = table if run_id is None else table.where(F.col("run_id") == run_id)
    return latest(table, list(key or KEYS[name]), ["seq"]).drop("seq")


def compact(spark: SparkSession, root: str, buckets: int = 8) -> None:
    """Rewrite the run tables so that reading them touches at most ``buckets`` files a run."""
    commits.compact(spark, root, KEYS, buckets, {name: _stored(name) for name in KEYS}, {name: _of_run(name) for name in KEYS})


def mergeable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes; others can't be stored."""
    for side in ("source", "target"):
        ends = nodes.select("graph_id", F.col("node_id").alias(f"{side}_node_id")).distinct()
        edges = edges.join(ends, ["graph_id", f"{side}_node_id"], "left_semi")
    return edges


GRAPH_KEYS = {"nodes": ("graph_id", "node_id"), "edges": ("graph_id", "edge_id")}


def write_graph(nodes: DataFrame, edges: DataFrame, root: str, seq: int = 0, buckets: int = 64) -> int:
    """Property-graph tables of a run, nodes and edges in one commit, dealt by node and by edge into ``buckets`` files.

    A later write of a key replaces the earlier one when read; the commit's number comes back.
    """
    tables = {"nodes": nodes, "edges": mergeable(nodes, edges)}
    dealt = {name: t.withColumn("seq", F.lit(seq).cast("long")).repartition(buckets, *GRAPH_KEYS[name]) for name, t in tables.items()}
    return commits.commit(nodes.sparkSession, root, dealt)


def read_graph(spark: SparkSession, root: str, commit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as of a commit, by default the last."""
    read = lambda name: latest(commits.rows(spark, root, name, number=commit), list(GRAPH_KEYS[name]), ["seq"]).drop("seq")
    return read("nodes"), read("edges")


def compact_graph(spark: SparkSession, root: str, buckets: int = 64) -> int:
    """Rewrite the graph's tables so that reading them touches one file a bucket."""
    return commits.compact(spark, root, GRAPH_KEYS, buckets)


def write_artifacts(df: DataFrame, folder: str) -> None:
    """Nested rows as JSON, a folder a baseline."""
    df.write.mode("overwrite").partitionBy("baseline").json(folder)


def write_csv(df: DataFrame, path: str) -> None:
    """Flat columns as CSV with a header; nested ones are left out."""
    flat = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_summary(summary: Mapping, path: str) -> None:
    """A small driver-side JSON report."""
    with open(path, "w") as f:
        json.dump(summary, f, indent=2, sort_keys=True, default=str)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)

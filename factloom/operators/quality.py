"""Graph quality: duplicate aliases, dangling edges, schema violations, disconnected nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.staging import staged

ISSUE = ["graph_id", "issue_type", "severity", "object_type", "object_id", "count", "missing_node_ids"]


def _issues(df: DataFrame, kind: str, severity: str, of: str, name: str, count=None, missing=None) -> DataFrame:
    return df.select(
        "graph_id",
        F.lit(kind).alias("issue_type"),
        F.lit(severity).alias("severity"),
        F.lit(of).alias("object_type"),
        F.col(name).cast("string").alias("object_id"),
        (F.lit(None) if count is None else F.col(count)).cast("long").alias("count"),
        (F.lit(None) if missing is None else F.col(missing)).cast("array<string>").alias("missing_node_ids"),
    )


def duplicate_aliases(nodes: DataFrame) -> DataFrame:
    """Aliases, whatever their case, that more than one (node, alias) pair has.

    ``nodes`` has an array ``aliases``, or a row for each pair with a column ``alias``.
    """
    alias = F.col("alias") if "alias" in nodes.columns else F.explode("aliases").alias("alias")
    pairs = nodes.select("graph_id", alias)
    counted = pairs.groupBy("graph_id", F.lower("alias").alias("alias")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _issues(counted, "duplicate_alias", "medium", "node_alias", "alias", count="n")


def with_missing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the endpoints that no node has, source first, as ``missing``."""
    known = nodes.select("graph_id", F.col("node_id").alias("known"))
    for side in ("source", "target"):
        there = known.withColumnsRenamed({"graph_id": f"_{side}_graph", "known": f"_{side}"})
        edges = edges.join(there, (F.col("graph_id") == F.col(f"_{side}_graph")) & (F.col(f"{side}_node_id") == F.col(f"_{side}")), "left").drop(f"_{side}_graph")
    missing = F.array_compact(F.array(*(F.when(F.col(f"_{s}").isNull(), F.col(f"{s}_node_id")) for s in ("source", "target"))))
    return edges.withColumn("missing", missing).drop("_source", "_target")


def _marked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges if "missing" in edges.columns else with_missing(nodes, edges)


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _issues(_marked(nodes, edges).where(F.size("missing") > 0), "dangling_edge", "high", "edge", "edge_id", missing="missing")


def schema_violations(nodes: DataFrame, edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges, dangling ones left aside, whose (profile, relation_type) the ontology does not list."""
    whole = _marked(nodes, edges).where(F.size("missing") == 0)
    return _issues(whole.join(allowed, ["profile", "relation_type"], "left_anti"), "schema_violation", "high", "edge", "edge_id")


def disconnected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge with two known endpoints touches."""
    whole = _marked(nodes, edges).where(F.size("missing") == 0)
    touched = whole.select("graph_id", F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"))
    return _issues(nodes.join(touched, ["graph_id", "node_id"], "left_anti"), "disconnected_node", "medium", "node", "node_id")


def analyze(nodes: DataFrame, edges: DataFrame, allowed: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """All issues; ``allowed`` is the (profile, relation_type) list of the ontology, ``aliases`` a table of (node, alias) if nodes hold none.

    Nodes, and edges with their missing endpoints, are worked out once for all four checks.
    """
    nodes = staged(nodes, "nodes")
    edges = staged(with_missing(nodes, edges), "edges")
    parts = [duplicate_aliases(nodes if aliases is None else aliases), dangling_edges(nodes, edges), schema_violations(nodes, edges, allowed), disconnected_nodes(nodes, edges)]
    return reduce(DataFrame.unionByName, parts).select(*ISSUE)


def counts(issues: DataFrame, *keys: str) -> DataFrame:
    return issues.groupBy(*keys, "issue_type").agg(F.count(F.lit(1)).alias("n_issues"))


def without_issues(edges: DataFrame, issues: DataFrame) -> DataFrame:
    """Edges that no issue names."""
    named = issues.where("object_type = 'edge'").select("graph_id", F.col("object_id").alias("edge_id"))
    return edges.join(named, ["graph_id", "edge_id"], "left_anti")


def annotated(nodes: DataFrame, edges: DataFrame, issues: DataFrame, supported: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the types of issue that name them, and edges with the questions they support; null if none.

    ``supported`` has (graph_id, question_id, edge_id).  Few issues and questions name one object, so the lists stay short.
    """
    listed = lambda of, name: issues.where(F.col("object_type") == of).groupBy("graph_id", F.col("object_id").alias(name)).agg(F.array_sort(F.collect_list("issue_type")).alias("quality_issues"))
    nodes = nodes.join(listed("node", "node_id"), ["graph_id", "node_id"], "left")
    edges = edges.join(listed("edge", "edge_id"), ["graph_id", "edge_id"], "left")
    if supported is not None:
        asked = supported.groupBy("graph_id", "edge_id").agg(F.array_sort(F.collect_list("question_id")).alias("query_support"))
        edges = edges.join(asked, ["graph_id", "edge_id"], "left")
    return nodes, edges

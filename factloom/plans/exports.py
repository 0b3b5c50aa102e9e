"""Exports of a run: its tables by run, answers with their evaluation, partial progress, overview, and the report's joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.numbers import rounded
from factloom.operators.tables import latest
from factloom.plans import dims
from factloom.sources import sinks

# The fields of a stored evaluation, and the order in which a run's tables are read.
EVALUATION = "token_f1 double, baseline string, intent_id string, support_score double, answerable boolean, filled_slots array<string>, missing_slots array<string>, missing_requirements array<string>"
ORDERS = {"question_answers": ("question_id",), "profile_decisions": ("doc_id", "baseline"), "graph_ingestion": ("doc_id", "baseline"), "artifacts": ("artifact_type", "doc_id")}
# End of fixed values.


def load(spark: SparkSession, root: str, name: str, run_id: str) -> DataFrame:
    """A run's rows of a table, as last written, in the table's order; only that run's folder is read."""
    return sinks.current(spark, root, name, run_id=run_id).orderBy(*ORDERS[name])


def load_run(spark: SparkSession, root: str, run_id: str) -> dict:
    """A run's own record."""
    found = sinks.current(spark, root, "experiment_runs", run_id=run_id).first()
    if found is None:
        raise LookupError(f"run not found: {run_id}")
    return found.asDict()


def evaluated(answers: DataFrame) -> DataFrame:
    """Stored answers with their parsed ``evaluation`` and ``baseline``: the evaluation's, else what stands before the colon of the question."""
    df = answers.withColumn("evaluation", F.from_json("evaluation_json", EVALUATION))
    prefix = F.when(F.contains("question_id", F.lit(":")), F.substring_index("question_id", ":", 1))
    return df.withColumn("baseline", F.coalesce("evaluation.baseline", prefix))


def answers_by_baseline(answers: DataFrame, seq: Sequence[str]) -> DataFrame:
    """(baseline, doc_id, category, token_f1) of the last answer of each document and baseline; answers whose evaluation names no baseline don't count."""
    df = evaluated(answers).where("evaluation.baseline IS NOT NULL")
    rows = df.select(F.col("evaluation.baseline").alias("baseline"), "doc_id", "category", F.coalesce("evaluation.token_f1", F.lit(0.0)).alias("token_f1"), *(F.col(c).alias(f"_seq_{c}") for c in seq))
    return latest(rows, ["baseline", "doc_id"], [f"_seq_{c}" for c in seq]).select("baseline", "doc_id", "category", "token_f1")


def partial_progress(answers: DataFrame, artifact_rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row a baseline that any of the three names: how many of each, and the mean score of its answers so far."""
    kinds = {
        "question_answers": evaluated(answers).select("baseline", F.col("evaluation.token_f1").alias("token_f1")),
        "artifact_rows": artifact_rows.select(F.col("artifact_type").alias("baseline"), F.lit(None).cast("double").alias("token_f1")),
        "artifact_payloads": payloads.select("baseline", F.lit(None).cast("double").alias("token_f1")),
    }
    rows = reduce(DataFrame.unionByName, (df.where("baseline IS NOT NULL").withColumn("kind", F.lit(kind)) for kind, df in kinds.items()))
    return rows.groupBy("baseline").agg(*(F.count_if(F.col("kind") == kind).alias(kind) for kind in kinds), rounded(F.avg("token_f1")).alias("partial_answer_quality_score"))


def answer_rows(answers: DataFrame, documents: DataFrame) -> DataFrame:
    """The export of answers, each with its document; an answer without a category takes its document's."""
    listed = lambda c: F.to_json(F.coalesce(F.col(f"evaluation.{c}"), F.array().cast("array<string>"))).alias(f"{c}_json")
    docs = documents.select("doc_id", F.col("category").alias("_category"), "sample_type", F.col("input_text").alias("question_text"))
    return evaluated(answers).join(docs, "doc_id", "left").select(
        "run_id",
        "baseline",
        "question_id",
        "doc_id",
        F.coalesce(F.nullif("category", F.lit("")), "_category").alias("category"),
        "sample_type",
        "question_text",
        "selected_profile",
        "query_template",
        F.col("evaluation.intent_id").alias("intent_id"),
        "answer_confidence",
        F.col("evaluation.token_f1").alias("token_f1"),
        F.col("evaluation.support_score").alias("support_score"),
        F.col("evaluation.answerable").alias("answerable"),
        *map(listed, ("filled_slots", "missing_slots", "missing_requirements")),
        "answer_text",
        "supporting_edges_json",
        "created_at",
    )


def artifact_rows(artifacts: DataFrame) -> DataFrame:
    """The export of artifacts, flat."""
    none = F.array().cast("array<string>")
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0)).cast("long")
    return artifacts.select(
        "baseline",
        "example_id",
        "profile_decision.selected_profile",
        "profile_decision.selection_confidence",
        F.col("extraction.metadata.mode").alias("extraction_mode"),
        "extraction.evaluation_gold_source",
        F.coalesce(F.nullif("query_support.intent_id", F.lit("")), "answer.evidence_bundle.intent_id").alias("intent_id"),
        size("extraction.entities").alias("entity_count"),
        size("extraction.relations").alias("relation_count"),
        "query_support.support_score",
        "query_support.answerable",
        F.to_json(F.coalesce("query_support.filled_slots", none)).alias("filled_slots_json"),
        F.to_json(F.coalesce("query_support.missing_requirements", none)).alias("missing_requirements_json"),
        "answer.token_f1",
        "answer.confidence",
        *(["file"] if "file" in artifacts.columns else []),
    )


#: What an overview takes from a run's summary.
OVERVIEW = ("profile_selection_accuracy", "ontology_constrained_extraction_f1", "query_support_path_coverage", "answer_quality_score", "answer_quality_delta", "answer_quality_delta_vs_question_only")


def overview_rows(run: dict, progress: DataFrame, summary: DataFrame) -> DataFrame:
    """One row a baseline that progress or summary names: counts so far and the summary's metrics."""
    have = set(summary.columns)
    wide = summary.select("baseline", *((F.col(m) if m in have else F.lit(None)).cast("double").alias(m) for m in OVERVIEW))
    # Both have a row a baseline.
    rows = progress.drop("artifact_rows").join(wide, "baseline", "full_outer").na.fill(0, ["question_answers", "artifact_payloads"])
    return rows.select(
        F.lit(run["run_id"]).alias("run_id"), F.lit(run["status"]).alias("run_status"), "baseline", F.col("question_answers").alias("question_answer_count"),
        F.col("artifact_payloads").alias("artifact_payload_count"), "partial_answer_quality_score", *OVERVIEW,
    )


def with_progress(overall: DataFrame, progress: DataFrame) -> DataFrame:
    """Snapshot rows (a baseline each) with a checkpoint's progress; its metrics fill in only what is null or lacking."""
    fixed = ["status", "processed_examples", "total_examples"]
    measured = [c for c in progress.columns if c not in ("run_id", "baseline", *fixed)]
    there = progress.select("baseline", *fixed, *(F.col(c).alias(f"_{c}") for c in measured))
    df = overall.join(there, "baseline", "left")
    df = df.withColumn("processed_examples", F.coalesce("processed_examples", "example_count"))
    return df.withColumns({c: F.coalesce(c, f"_{c}") if c in overall.columns else F.col(f"_{c}") for c in measured}).drop(*(f"_{c}" for c in measured))


def metric_lookup(tables: Sequence[DataFrame]) -> DataFrame:
    """(baseline, metric, value) of wide tables with a row a baseline, nulls left out; of equal names the last table's counts."""
    parts = []
    for nth, table in enumerate(tables):
        names = [c for c in table.columns if c != "baseline"]
        long = table.select("baseline", *(F.col(c).cast("double") for c in names)).unpivot(["baseline"], names, "metric", "value")
        parts.append(long.where("value IS NOT NULL AND baseline IS NOT NULL").withColumn("_nth", F.lit(nth)))
    return latest(reduce(DataFrame.unionByName, parts), ["baseline", "metric"], ["_nth"]).drop("_nth")


def overridden(summary: DataFrame, lookup: DataFrame) -> DataFrame:
    """Bootstrap rows (baseline, category, metric, mean, ci_low, ci_high, n) whose overall means give way to a run's own; intervals move along."""
    df = summary.join(lookup.withColumnRenamed("value", "_official"), ["baseline", "metric"], "left")
    taken = (F.col("category") == "overall") & F.col("_official").isNotNull()
    delta = F.col("_official") - F.col("mean")
    moved = {c: F.when(taken, rounded(F.col(c) + delta)).otherwise(F.col(c)) for c in ("ci_low", "ci_high")}
    df = df.withColumns({**moved, "mean_source": F.when(taken, "run_summary").otherwise("bootstrap")})
    return df.withColumn("mean", F.when(taken, rounded(F.col("_official"))).otherwise(F.col("mean"))).drop("_official")


MANUAL_EVALUATION = "baselines map<string, struct<per_example: array<struct<example_id: string, category: string, required_slot_coverage_manual: double, preferred_evidence_hit_rate: double>>>>"


def manual_rows(evaluations: DataFrame, json: str = "value") -> DataFrame:
    """(baseline, category, coverage, hit rate) of nested manual evaluations, a row an example."""
    df = evaluations.select(F.from_json(json, MANUAL_EVALUATION).alias("e")).select(F.explode("e.baselines").alias("baseline", "b"))
    df = df.select("baseline", F.explode("b.per_example").alias("x"))
    return df.select("baseline", "x.category", F.col("x.required_slot_coverage_manual").alias("required_answer_slot_coverage_manual"), F.col("x.preferred_evidence_hit_rate").alias("preferred_answer_evidence_hit_rate"))


def report_lookup(sections: Sequence[DataFrame]) -> DataFrame:
    """The rows of a report's sections by (baseline, category, metric); of equal keys the last section's row stays."""
    numbered = reduce(DataFrame.unionByName, (df.withColumn("_nth", F.lit(i)) for i, df in enumerate(sections)))
    return latest(numbered, ["baseline", "category", "metric"], ["_nth"]).drop("_nth")


def with_interval(mean: Column, low: Column, high: Column) -> Column:
    """``m [lo, hi]`` to three places; without an interval the mean alone, without a mean a dash."""
    text = lambda x: F.format_string("%.3f", rounded(x))
    return F.when(mean.isNull(), "-").when(low.isNull() | high.isNull(), text(mean)).otherwise(F.concat(text(mean), F.lit(" ["), text(low), F.lit(", "), text(high), F.lit("]")))


#: The metrics of a report's wide table.
WIDE = ("answer_quality_score", "profile_selection_accuracy", "ontology_constrained_extraction_f1", "query_support_path_coverage", "relation_schema_conformance_rate", "fallback_error_rate")


def wide_table(report: DataFrame, anchor: str = "graph_without_ontology_constraints") -> DataFrame:
    """One row a graph baseline: its overall metrics as text, and its answers' quality less the anchor's (0 if there is no anchor)."""
    built = [name for name, flags in dims.BASELINES.items() if flags[0] is not None]
    rows = report.where((F.col("category") == "overall") & F.col("baseline").isin(*built))
    shown = rows.groupBy("baseline").pivot("metric", list(WIDE)).agg(F.first(with_interval(F.col("mean"), F.col("ci_low"), F.col("ci_high"))))
    score = rows.where("metric = 'answer_quality_score'").select("baseline", "mean")
    base = score.agg(F.coalesce(F.max(F.when(F.col("baseline") == anchor, F.col("mean"))), F.lit(0.0)).alias("_base"))  # one row
    delta = score.crossJoin(F.broadcast(base)).select("baseline", with_interval(F.col("mean") - F.col("_base"), F.lit(None), F.lit(None)).alias("answer_quality_delta"))
    all_built = report.sparkSession.createDataFrame([(b,) for b in built], "baseline string")
    return all_built.join(shown, "baseline", "left").join(delta, "baseline", "left").na.fill("-", [*WIDE, "answer_quality_delta"])

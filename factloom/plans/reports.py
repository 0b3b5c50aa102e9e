"""Run reports: artifact records, baseline summaries, metric rows, manual-gold evaluation, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import rounded
from factloom.functions.text import normalize
from factloom.operators import extract, metrics
from factloom.plans import dims
from factloom.sources.staging import staged

_ENTITY = "struct<name: string, entity_type: string, confidence: double, source_doc_id: string>"
_RELATION = "struct<source_name: string, relation_type: string, target_name: string, confidence: double, source_doc_id: string>"
_TRIPLE = "struct<edge_id: string, source_name: string, source_type: string, relation_type: string, target_name: string, target_type: string, confidence: double, provenance_snippets: array<string>>"
_BUNDLE = f"struct<mode: string, answer_generation_mode: string, intent_id: string, answerable: boolean, reference_sentences: array<string>, missing_slots: array<string>, filled_slots: array<string>, missing_requirements: array<string>, matched_relations: array<string>, matched_entity_types: array<string>, triples: array<{_TRIPLE}>>"
#: A per-example artifact.
ARTIFACT = (
    "example_id string, baseline string, error string, "
    "profile_decision struct<selected_profile: string, candidate_profiles: array<string>, selection_confidence: double, mapping_policy: string, ontology_rationale: string>, "
    f"extraction struct<metadata: struct<mode: string, fallback_reason: string>, evaluation_gold_source: string, entities: array<{_ENTITY}>, relations: array<{_RELATION}>>, "
    "quality_issues array<struct<issue_type: string, severity: string, message: string, object_type: string, object_id: string>>, "
    "query_support struct<question_id: string, query_template: string, target_profile: string, intent_id: string, support_score: double, answerable: boolean, supporting_edge_ids: array<string>, "
    "missing_requirements: array<string>, matched_relations: array<string>, matched_entity_types: array<string>, filled_slots: array<string>>, "
    f"answer struct<question_id: string, category: string, profile_used: string, question: string, answer: string, ground_truth_answer: string, token_f1: double, confidence: double, selected_edge_ids: array<string>, quality_notes: array<string>, evidence_bundle: {_BUNDLE}>"
)


def _size(*names: str) -> Column:
    """Size of the first of the named arrays that holds anything."""
    sizes = [F.size(F.coalesce(F.col(n), F.array())) for n in names]
    return F.coalesce(*(F.when(s > 0, s) for s in sizes), F.lit(0)).cast("long")


def conformance(profile: Column, relations: Column) -> Column:
    """Share of relations that the profile allows; null without relations or for an unknown profile."""
    allowed = F.create_map(*(x for p, rels in dims.PROFILES.items() for x in (F.lit(p), F.array(*map(F.lit, rels)))))[profile]
    good = F.size(F.filter(relations, lambda r: F.array_contains(allowed, r["relation_type"])))
    return rounded(F.when((F.size(F.coalesce(relations, F.array())) > 0) & allowed.isNotNull(), good / F.size(relations)))


def fallback_or_error(rationale: str = "profile_decision.ontology_rationale") -> Column:
    """1 if any step of the artifact fell back or failed."""
    bundle = F.col("answer.evidence_bundle")
    signs = [
        F.coalesce(F.col("error"), F.lit("")) != "",
        F.col("extraction.metadata.mode") == "heuristic_fallback",
        bundle["answer_generation_mode"].isin("heuristic_answer_fallback", "runtime_error_fallback"),
        bundle["mode"] == "runtime_error_fallback",
        F.contains(F.col(rationale), F.lit("Heuristic fallback used")),
    ]
    hit = F.lit(False)
    for sign in signs:
        hit = hit | F.coalesce(sign, F.lit(False))
    return F.when(hit, 1.0).otherwise(0.0)


def records(artifacts: DataFrame) -> DataFrame:
    """Flat counts and scores of each artifact."""
    kinds = lambda c, f: F.coalesce(F.size(F.array_distinct(F.array_compact(F.transform(c, lambda m: m[f])))), F.lit(0)).cast("long")
    issues = lambda kind: F.size(F.filter(F.coalesce("quality_issues", F.array().cast(artifacts.schema["quality_issues"].dataType)), lambda i: i["issue_type"] == kind)).cast("long")
    score = F.col("query_support.support_score")
    return artifacts.select(
        "baseline",
        "example_id",
        F.col("profile_decision.selected_profile").alias("selected_profile"),
        _size("extraction.entities").alias("entity_count"),
        _size("extraction.relations").alias("relation_count"),
        kinds(F.col("extraction.entities"), "entity_type").alias("unique_entity_type_count"),
        kinds(F.col("extraction.relations"), "relation_type").alias("unique_relation_type_count"),
        conformance(F.col("profile_decision.selected_profile"), F.col("extraction.relations")).alias("allowed_relation_ratio"),
        _size("quality_issues").alias("quality_issue_count"),
        issues("schema_violation").alias("schema_violation_count"),
        issues("disconnected_node").alias("disconnected_node_count"),
        issues("dangling_edge").alias("dangling_edge_count"),
        score.alias("support_score"),
        F.coalesce(score > 0, F.lit(False)).alias("support_positive"),
        F.coalesce("query_support.answerable", F.lit(False)).alias("answerable"),
        _size("query_support.matched_relations", "answer.evidence_bundle.matched_relations").alias("matched_relation_count"),
        _size("query_support.matched_entity_types", "answer.evidence_bundle.matched_entity_types").alias("matched_entity_type_count"),
        _size("query_support.filled_slots", "answer.evidence_bundle.filled_slots").alias("filled_slot_count"),
        _size("query_support.missing_requirements", "answer.evidence_bundle.missing_requirements").alias("missing_requirement_count"),
        _size("answer.selected_edge_ids").alias("selected_edge_count"),
        _size("answer.evidence_bundle.triples").alias("evidence_triple_count"),
        F.col("answer.token_f1").alias("token_f1"),
    )


def baseline_summary(flat: DataFrame) -> DataFrame:
    """Means of the records by baseline; what is null does not count."""
    counted = [c for c, kind in flat.dtypes if c.endswith("_count")]
    mean = lambda c: rounded(F.avg(c))
    rate = lambda c: rounded(F.avg(F.col(c).cast("int").cast("double")))
    return flat.groupBy("baseline").agg(
        F.count(F.lit(1)).alias("sample_count"),
        *(mean(c).alias(f"avg_{c}") for c in counted),
        mean("allowed_relation_ratio").alias("relation_schema_conformance_rate"),
        rate("support_positive").alias("query_support_positive_rate"),
        rate("answerable").alias("answerable_rate"),
        mean("support_score").alias("avg_support_score"),
        mean("token_f1").alias("avg_answer_token_f1"),
    )


def histogram(artifacts: DataFrame, items: str, kind: str) -> DataFrame:
    """(baseline, kind, n), most frequent first."""
    rows = artifacts.select("baseline", F.explode(items).alias("m")).select("baseline", F.col(f"m.{kind}").alias(kind)).where(F.col(kind).isNotNull())
    return rows.groupBy("baseline", kind).agg(F.count(F.lit(1)).alias("n")).orderBy("baseline", F.desc("n"), kind)


def profile_histogram(flat: DataFrame) -> DataFrame:
    """(baseline, selected_profile, n) of the records that name one, most frequent first."""
    named = flat.where(F.coalesce("selected_profile", F.lit("")) != "")
    return named.groupBy("baseline", "selected_profile").agg(F.count(F.lit(1)).alias("n")).orderBy("baseline", F.desc("n"), "selected_profile")


#: What a summary is compared in.
COMPARED = (
    "avg_entity_count", "avg_relation_count", "relation_schema_conformance_rate", "avg_schema_violation_count", "avg_disconnected_node_count",
    "avg_support_score", "answerable_rate", "avg_filled_slot_count", "avg_selected_edge_count", "avg_answer_token_f1",
)


def delta_table(summary: DataFrame, anchor: str) -> DataFrame:
    """Each baseline's summary less the anchor's, in the metrics ``COMPARED``; null where either is; no anchor, no rows."""
    found = metrics.delta_vs(summary, anchor, "baseline", COMPARED)
    return found.select("baseline", F.lit(anchor).alias("delta_against"), *(rounded(F.col(f"{m}_delta")).alias(f"{m}_delta") for m in COMPARED))


def _canonical(category: Column) -> Column:
    return F.replace(F.trim(F.regexp_replace(F.lower(category), r"\s+", " ")), F.lit(" "), F.lit("_"))


def with_mention_scores(df: DataFrame, entities: Column, relations: Column, gold_entities: Column, gold_relations: Column) -> DataFrame:
    """``df`` with entity and relation precision, recall and F1 of two arrays of mentions each, all on one row; names count in normal form."""
    n = normalize
    of_entity = lambda m: metrics.item(n(m["name"]), m["entity_type"])
    of_relation = lambda m: metrics.item(n(m["source_name"]), m["relation_type"], n(m["target_name"]))
    sides = {"entity": (entities, gold_entities, of_entity), "relation": (relations, gold_relations, of_relation)}
    return metrics.with_array_scores(df, {kind: (F.transform(p, of), F.transform(g, of)) for kind, (p, g, of) in sides.items()})


def artifact_extraction_f1(artifacts: DataFrame, keep: Sequence[Column] = ()) -> DataFrame:
    """(baseline, example_id, ontology_constrained_extraction_f1) against the proxy gold of question and answer; 0 if nothing was predicted.

    What is to ``keep`` of the artifact comes along.
    """
    a, none = F.col("answer"), F.lit("")
    kept = artifacts.select(*keep).columns
    asked = artifacts.select(
        "baseline", "example_id", *keep, F.coalesce("extraction.entities", F.array().cast(f"array<{_ENTITY}>")).alias("_entities"), F.coalesce("extraction.relations", F.array().cast(f"array<{_RELATION}>")).alias("_relations"),
        F.coalesce(a["question"], none).alias("_question"), F.coalesce(a["ground_truth_answer"], none).alias("_truth"), _canonical(F.coalesce(a["category"], none)).alias("_canonical"),
    )
    judged = extract.induced_gold(asked, "_question", "_truth", "_canonical")
    judged = with_mention_scores(judged, F.col("_entities"), F.col("_relations"), F.col("gold_entities"), F.col("gold_relations"))
    empty = F.size("_entities") + F.size("_relations") == 0
    return judged.select("baseline", "example_id", *kept, F.when(empty, 0.0).otherwise(rounded((F.col("entity_f1") + F.col("relation_f1")) / 2)).alias("ontology_constrained_extraction_f1"))


def metric_rows(answers: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per-example metrics: answers (baseline, doc_id, category, token_f1) and artifacts, outer joined.

    The delta is against the reference-only answer of the same document; metrics of graphs are null
    for baselines without one.
    """
    built = [n for n, f in dims.BASELINES.items() if f[0] is not None]
    # Nested rows are read once for all that is taken from them.
    artifacts = staged(artifacts.select("baseline", "example_id", "error", "profile_decision", "extraction", "query_support", "answer"), "artifacts")
    kept = [
        F.col("answer.category").alias("_category"),
        F.col("query_support.support_score").alias("query_support_path_coverage"),
        conformance(F.col("profile_decision.selected_profile"), F.col("extraction.relations")).alias("relation_schema_conformance_rate"),
        fallback_or_error().alias("fallback_error_rate"),
        F.col("profile_decision.selected_profile").alias("_profile"),
    ]
    art = artifact_extraction_f1(artifacts, kept).withColumnRenamed("example_id", "doc_id")
    reference = answers.where("baseline = 'reference_only_baseline'").select("doc_id", F.col("token_f1").alias("_reference"))
    # All of these grow with the run: a small file may hold very many rows, so none is broadcast by its size.
    df = answers.join(art.hint("merge"), ["baseline", "doc_id"], "full_outer").join(reference.hint("merge"), "doc_id", "left")
    df = df.withColumn("category", F.coalesce("category", "_category")).where("category IS NOT NULL")
    graph, chosen = F.col("baseline").isin(built), F.col("baseline").isin(built[1:])
    of_category = _canonical(F.col("category"))
    return df.select(
        "baseline",
        "doc_id",
        "category",
        F.col("token_f1").alias("answer_quality_score"),
        rounded(F.col("token_f1") - F.col("_reference")).alias("answer_quality_delta"),
        F.when(chosen, (F.col("_profile") == of_category).cast("double")).alias("profile_selection_accuracy"),
        *(F.when(graph, F.col(c)).alias(c) for c in ("ontology_constrained_extraction_f1", "query_support_path_coverage", "relation_schema_conformance_rate", "fallback_error_rate")),
    )


def metric_summary(rows: DataFrame, names: Sequence[str], resamples: int = 2000) -> DataFrame:
    """(scope, baseline, metric, mean, low, high, n) over all and by category, from the unpivoted metric rows."""
    long = rows.unpivot(["baseline", "doc_id", "category"], list(names), "metric", "value").where("value IS NOT NULL")
    scoped = long.withColumn("scope", F.explode(F.array(F.lit("overall"), F.col("category"))))
    return metrics.bootstrap(scoped, "value", "doc_id", ["scope", "baseline", "metric"], resamples)


def snapshot(answers: DataFrame) -> DataFrame:
    """Counts and means by baseline, and by baseline and category, of stored answers with their JSON evaluation."""
    from_json = lambda path: F.get_json_object("evaluation_json", path)
    df = answers.select(
        F.substring_index("question_id", ":", 1).alias("baseline"),
        "category",
        from_json("$.token_f1").cast("double").alias("f"),
        F.col("answer_confidence").alias("c"),
        from_json("$.support_score").cast("double").alias("s"),
        from_json("$.answerable").cast("boolean").cast("int").alias("a"),
    )
    mean = lambda c, name: rounded(F.avg(c)).alias(name)
    sets = df.groupingSets([[F.col("baseline")], [F.col("baseline"), F.col("category")]], "baseline", "category")
    return sets.agg(F.grouping("category").cast("int").alias("is_total"), F.count(F.lit(1)).alias("example_count"), mean("f", "answer_quality_score"), mean("c", "avg_answer_confidence"), mean("s", "avg_support_score"), mean("a", "answerable_rate"))


def manual_gold_scores(artifacts: DataFrame, gold: DataFrame) -> DataFrame:
    """Artifacts against manual gold, one row an artifact that has gold: profile, intent, extraction, slots, evidence; null where gold lists nothing."""
    # Both sides grow with the run: a small file may hold very many rows, so neither is broadcast by its size.
    df = staged(artifacts.join(gold.withColumnsRenamed({"category": "gold_category", "intent_id": "gold_intent_id"}).hint("merge"), "example_id"), "judged")
    bundle = F.col("answer.evidence_bundle")
    none = F.array().cast("array<string>")
    triples = F.transform(bundle["triples"], lambda t: F.concat_ws(" ", t["source_name"], t["relation_type"], t["target_name"], F.array_join(t["provenance_snippets"], " ")))
    text = normalize(F.concat_ws(" ", F.col("answer.answer"), F.array_join(F.coalesce(bundle["reference_sentences"], none), " "), F.array_join(F.coalesce(triples, none), " ")))
    needed, wanted = F.array_distinct("required_answer_slots"), F.col("preferred_answer_evidence")
    filled = F.array_sort(F.array_distinct(F.coalesce(bundle["filled_slots"], none)))
    hits = F.size(F.filter(wanted, lambda t: F.contains(text, normalize(t))))
    intent = F.coalesce(F.nullif(F.col("query_support.intent_id"), F.lit("")), bundle["intent_id"], F.lit(""))
    keys = ["baseline", "example_id"]
    entities, relations = F.array().cast(f"array<{_ENTITY}>"), F.array().cast(f"array<{_RELATION}>")
    df = with_mention_scores(df, F.coalesce("extraction.entities", entities), F.coalesce("extraction.relations", relations), F.col("gold_entities"), F.col("gold_relations"))
    selected = F.col("profile_decision.selected_profile")
    judged = df.select(
        *keys,
        F.col("gold_category").alias("category"),
        "gold_profile",
        selected.alias("predicted_profile"),
        selected.eqNullSafe(F.col("gold_profile")).alias("profile_match"),
        "gold_intent_id",
        intent.alias("predicted_intent_id"),
        (intent == F.col("gold_intent_id")).alias("intent_match"),
        filled.alias("filled_slots"),
        rounded(F.when(F.size(needed) > 0, F.size(F.array_intersect(needed, filled)) / F.size(needed))).alias("required_slot_coverage"),
        rounded(F.when(F.size(wanted) > 0, hits / F.size(wanted))).alias("preferred_evidence_hit_rate"),
        F.col("answer.token_f1").alias("answer_token_f1"),
        F.col("extraction.evaluation_gold_source").alias("evaluation_gold_source"),
        F.col("error").alias("artifact_error"),
        *(rounded(F.col(f"{kind}_{c}")).alias(f"{kind}_{c}") for kind in ("entity", "relation") for c in ("precision", "recall", "f1")),
    )
    return judged.withColumn("extraction_f1_manual", rounded((F.col("entity_f1") + F.col("relation_f1")) / 2))


def manual_gold_missing(artifacts: DataFrame, gold: DataFrame) -> DataFrame:
    """(baseline, example_id) of gold examples that a baseline has no artifact for."""
    baselines = artifacts.select("baseline").distinct().groupBy().agg(F.collect_list("baseline").alias("b"))  # six names or so
    wanted = gold.select("example_id").crossJoin(F.broadcast(baselines)).select(F.explode("b").alias("baseline"), "example_id")
    return wanted.join(artifacts.select("baseline", "example_id").hint("merge"), ["baseline", "example_id"], "left_anti")


def manual_gold_summary(scores: DataFrame, missing: DataFrame) -> DataFrame:
    """One row a baseline: counts and six means; what is null does not count."""
    mean = lambda c, name: rounded(F.avg(F.col(c).cast("double"))).alias(name)
    match = lambda c, name: rounded(F.avg(F.col(c).cast("int").cast("double"))).alias(name)
    found = scores.groupBy("baseline").agg(
        F.count(F.lit(1)).alias("sample_count"),
        match("profile_match", "profile_selection_accuracy_manual"),
        match("intent_match", "intent_accuracy_manual"),
        mean("extraction_f1_manual", "ontology_constrained_extraction_f1_manual"),
        mean("required_slot_coverage", "required_answer_slot_coverage_manual"),
        mean("preferred_evidence_hit_rate", "preferred_answer_evidence_hit_rate"),
        mean("answer_token_f1", "answer_token_f1"),
    )
    lost = missing.groupBy("baseline").agg(F.count(F.lit(1)).alias("missing_artifact_count"))
    return found.join(lost, "baseline", "full_outer").na.fill(0, ["sample_count", "missing_artifact_count"])

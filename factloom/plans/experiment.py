"""The main experiment: one isolated graph an example and baseline, heuristic backend by default.

``baseline`` is a column and graph_id = baseline:example, so no driver loop touches examples, and
every graph operator keeps the key (graph_id, ...).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions.numbers import rounded
from factloom.operators import answers, evidence, extract, graph, metrics, profiles, quality, support, tables
from factloom.operators.backend import Backend, ask, choose_extraction, choose_profile, failure, requests
from factloom.plans import dims
from factloom.plans.reports import with_mention_scores
from factloom.plans.sample import allowed_relations
from factloom.sources.staging import staged

GRAPH_BASELINES = [name for name, flags in dims.BASELINES.items() if flags[0] is not None]


@dataclass(frozen=True)
class Config:
    """Settings of a run, with their usual values."""

    sample_size: int | None = None
    per_category_limit: int | None = 25
    max_references: int = 2
    reference_sentence_limit: int = 4
    graph_triple_limit: int = 5
    snippet_limit: int = 3
    context_char_budget: int = 2200
    max_workers: int = 4
    call_timeout_seconds: float = 90.0
    checkpoint_every_examples: int = 10
    #: Folder of a table of the model's answers, by which a run that broke off is taken up; None keeps them for the session.
    ledger: str | None = None

    def calls(self) -> dict:
        return {"workers": self.max_workers, "timeout": self.call_timeout_seconds, "ledger": self.ledger}


def with_intents(examples: DataFrame) -> DataFrame:
    """Adds intent_id and what the intent requires."""
    df = examples.withColumn("intent_id", profiles.intent(F.col("target_profile"), F.col("question_text"), dims.INTENTS, dims.DEFAULT_INTENTS))
    specs = {name: spec for group in dims.INTENTS.values() for name, spec in group.items()}
    listed = lambda i: F.create_map(*(x for name, spec in specs.items() for x in (F.lit(name), F.array(*map(F.lit, spec[i])))))[F.col("intent_id")]
    return df.withColumns({"required_relations": listed(1), "required_entity_types": listed(2), "focus_slots": listed(3)})


TASKS = ("profile", "extraction", "answer")
#: Columns of examples that no graph needs.
TEXTS = ("question_text", "answer_text", "references", "source_text")


def extractions(examples: DataFrame, backend: Backend | None = None, tasks: Sequence[str] = TASKS, calls: Mapping | None = None) -> DataFrame:
    """(example without ``TEXTS``, baseline, selected_profile, entities, relations, error) of the graph baselines.

    A ``backend`` chooses profiles and extracts where ``tasks`` say so; where it fails, the heuristics
    stay, and where it gives a request up for good, ``error`` says why.  ``calls`` are settings of ``ask``.
    """
    flags = F.array(*(F.struct(F.lit(n).alias("baseline"), F.lit(dims.BASELINES[n][0]).alias("selects"), F.lit(dims.BASELINES[n][1]).alias("constrained"), F.lit(dims.BASELINES[n][3]).alias("aware")) for n in GRAPH_BASELINES))
    combined = F.when(F.trim("source_text") != "", F.col("source_text")).otherwise(F.col("question_text"))
    chosen = profiles.by_keywords(examples, combined, dims.PROFILE_KEYWORDS, F.col("target_profile"))
    request = ["example_id", "task", "instructions", "prompt", "temperature"]
    if backend is not None and "profile" in tasks:
        chosen = chosen.withColumnsRenamed({"confidence": "selection_confidence"})
        asked = ask(requests(chosen, "profile"), backend, request, **(calls or {}))
        chosen = choose_profile(asked, "response").withColumn("error", failure("response")).drop(*request[1:], "response", "response_error")
    else:
        chosen = chosen.withColumn("error", F.lit(None).cast("string"))
    chosen = extract.prepared(chosen.withColumn("by_keywords", F.col("selected_profile")), "source_text")
    # The text is searched once an example, and what is found by either profile is exploded: no text is written, and none copied to the baselines.
    kinds = ("entities", "relations")
    for profile in ("target_profile", "by_keywords"):
        chosen = extract.extract(chosen, profile=profile, names=tuple(f"{profile}_{c}" for c in kinds), keep=True)
    df = chosen.drop(*extract.SHARED, *(c for c in TEXTS if c != "source_text")).withColumn("_b", F.explode(flags)).select("*", "_b.*").drop("_b")
    taken = lambda c: F.when(F.col("selects"), F.col(f"by_keywords{c}")).otherwise(F.col(f"target_profile{c}"))
    df = df.withColumns({"selected_profile": taken("")} | {c: taken(f"_{c}") for c in kinds}).drop(*(f"{p}_{c}" for p in ("target_profile", "by_keywords") for c in kinds))
    if backend is not None and "extraction" in tasks:
        asked = ask(requests(df, "extraction", F.col("selected_profile")).drop("source_text"), backend, request, **(calls or {}))
        df = choose_extraction(asked, "response").withColumn("error", F.coalesce("error", failure("response"))).drop(*request[1:], "response", "response_error")
    worn = {c: F.col(f"_{c}") for c in kinds}
    both = extract.degraded(df.withColumns({f"_{c}": F.col(c) for c in worn}))
    # ``_entities`` and ``_relations`` are as extracted, the plain names degraded.
    both = both.withColumns({c: F.when(F.col("constrained"), kept).otherwise(F.col(c)) for c, kept in worn.items()})
    return both.drop("_entities", "_relations", "source_text").withColumn("graph_id", F.concat_ws(":", "baseline", "example_id"))


def _mentions(df: DataFrame, column: str) -> DataFrame:
    return df.select("graph_id", F.lit(0).alias("doc_ord"), F.col("example_id").alias("doc_id"), F.col("selected_profile").alias("profile"), F.posexplode(column).alias("pos", "_m")).select("graph_id", "doc_ord", "doc_id", "profile", "pos", "_m.*")


def resolved_gold(df: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Adds gold_entities, gold_relations and evaluation_gold_source: manual gold where there is any, else the proxy of question and answer.

    ``manual`` has (example_id, gold_entities, gold_relations); all names come in normal form.
    """
    return with_manual_gold(extract.induced_gold(df, "question_text", "answer_text", "target_profile"), manual)


def with_manual_gold(df: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """``df`` with manual gold in place of its own where there is any, and evaluation_gold_source."""
    if manual is None:
        return df.withColumn("evaluation_gold_source", F.lit("induced_proxy"))
    n = X.normalize
    known = manual.select(
        "example_id",
        F.transform("gold_entities", lambda e: F.struct(n(e["name"]).alias("name"), e["entity_type"].alias("entity_type"))).alias("_manual_e"),
        F.transform("gold_relations", lambda r: F.struct(n(r["source_name"]).alias("source_name"), r["relation_type"].alias("relation_type"), n(r["target_name"]).alias("target_name"))).alias("_manual_r"),
        F.lit(True).alias("_manual"),
    )
    df = df.join(known, "example_id", "left")
    given = F.coalesce("_manual", F.lit(False))
    of = lambda c, kept: F.when(given, F.coalesce(F.array_distinct(kept), F.array().cast(df.schema[c].dataType))).otherwise(F.col(c))
    return df.withColumns({"gold_entities": of("gold_entities", "_manual_e"), "gold_relations": of("gold_relations", "_manual_r"), "evaluation_gold_source": F.when(given, "manual_gold").otherwise("induced_proxy")}).drop("_manual", "_manual_e", "_manual_r")


def extraction_scores(df: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """``df`` with extraction_f1 and evaluation_gold_source in place of its gold; F1s are rounded before their mean."""
    df = with_manual_gold(df, manual)
    columns = [c for c in df.columns if c not in ("gold_entities", "gold_relations")]
    df = with_mention_scores(df, F.col("entities"), F.col("relations"), F.col("gold_entities"), F.col("gold_relations"))
    return df.select(*columns, rounded((rounded(F.col("entity_f1")) + rounded(F.col("relation_f1"))) / 2).alias("extraction_f1"))


def run(examples: DataFrame, config: Config | None = None, manual: DataFrame | None = None, backend: Backend | None = None, tasks: Sequence[str] = TASKS) -> DataFrame:
    """One row an example and baseline: profile, graph size, issues, support, answer, scores.

    ``examples`` are the rows of ``load_examples``, ``manual`` manual gold.  A ``backend`` does the
    ``tasks`` named: it chooses profiles, extracts, and answers every baseline from its context by the
    same prompt; where it fails, what the heuristics say stays.  A row whose request it gives up for good
    has an ``error``, and counts as ``failed`` says.

    Texts stay with the examples and are written nowhere: what the graphs say is gathered by example, and
    the examples are joined to it once, for snippets and answers.  Rows are worked out when they are read;
    who reads them more than once may stage them.
    """
    config = config or Config()
    spark = examples.sparkSession
    examples = with_intents(examples)
    # Mentions and graph feed every later table.
    known = extract.induced_gold(examples, "question_text", "answer_text", "target_profile")
    made = staged(extraction_scores(extractions(known, backend, tasks, config.calls()), manual), "extractions")
    entities, relations = _mentions(made, "entities"), _mentions(made, "relations")
    nodes, edges = (staged(table, "graph") for table in graph.build(entities, relations, sets=False))
    issues = staged(quality.analyze(nodes, edges, allowed_relations(spark), graph.node_sets(entities, relations)[0]), "issues")
    questions = made.select("graph_id", F.col("example_id").alias("question_id"), "target_profile", "intent_id", "required_relations", "required_entity_types", "focus_slots")
    found = support.analyze(questions, edges, nodes, dims.SLOT_HINTS)

    ends = nodes.select("graph_id", "node_id", "name", "entity_type")
    side = lambda s: ends.withColumnsRenamed({"node_id": f"{s}_node_id", "name": f"{s}_name", "entity_type": f"{s}_type"})
    aware = made.where("aware").select("graph_id")
    kept = quality.without_issues(edges, issues.join(aware, "graph_id", "left_semi"))
    used = support.supporting_edges(questions, kept).join(side("source"), ["graph_id", "source_node_id"], "left").join(side("target"), ["graph_id", "target_node_id"], "left")
    bundles = evidence.bundle(used, None, ["graph_id"])
    n_issues = issues.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_issues"))
    n_nodes = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"))

    df = made.select("error", "graph_id", "baseline", "example_id", "target_profile", "by_keywords", "selected_profile", "intent_id", F.size("entities").alias("n_entities"), F.size("relations").alias("n_relations"), "focus_slots", "required_relations", "required_entity_types", "extraction_f1", "evaluation_gold_source")
    for other in (found.drop("question_id", "target_profile", "intent_id"), bundles, n_issues, n_nodes):
        df = df.join(other, "graph_id", "left")
    df = df.na.fill(0, ["n_edges", "n_issues", "n_nodes"])
    held = df.groupBy(F.col("example_id").alias("_example")).agg(F.collect_list(F.struct(*(c for c in df.columns if c != "example_id"))).alias("graphs"))
    held = staged(held, "graphs")
    texts = examples.select("example_id", "category", "question_text", "answer_text", "references")
    # Merged, not broadcast: the file is small for its rows.
    df = texts.join(held.hint("merge"), F.col("example_id").eqNullSafe(F.col("_example"))).drop("_example")
    df = evidence.exploded_with_snippets(df, "graphs", limit=config.snippet_limit)
    missing = support.missing_slots(F.col("missing_requirements"))
    df = df.withColumns({"answer": answers.from_bundle(F.col("triples"), missing), "confidence": answers.graph_confidence(F.col("n_edges"), F.col("support_score"))})

    best = evidence.ranked_sentences(examples, "question_text", limit=config.reference_sentence_limit)
    best = best.withColumn("sentences", F.when(F.size("best") > 0, F.transform("best", lambda x: x["sentence"])))
    plain = best.select("sentences", "example_id", "category", "question_text", "answer_text", "target_profile", "intent_id", "references", "focus_slots", "required_relations", "required_entity_types")
    reference = plain.withColumns({"baseline": F.lit("reference_only_baseline"), "answer": F.coalesce(F.array_join("sentences", " "), F.lit("Reference context did not provide grounded answer text.")), "confidence": F.lit(0.35)})
    asked = plain.drop("sentences").withColumns({"baseline": F.lit("question_only_baseline"), "answer": F.lit("Insufficient grounded context to answer from the question alone."), "confidence": F.lit(0.12)})
    rows = df.unionByName(reference, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    mode = F.when(F.col("baseline").isin(GRAPH_BASELINES), "graph_evidence_bundle").otherwise(F.replace(F.col("baseline"), F.lit("_baseline"), F.lit("")))
    rows = rows.withColumns({"graph_id": F.concat_ws(":", "baseline", "example_id"), "context_mode": mode, "missing_slots": F.coalesce(support.missing_slots(F.col("missing_requirements")), F.array().cast("array<string>"))})
    answered = backend is not None and "answer" in tasks
    if answered:
        context = answers.context(F.col("context_mode"), F.col("question_text"), F.col("intent_id"), F.col("sentences"), F.col("triples"), F.col("missing_slots"), config.context_char_budget, config.reference_sentence_limit, config.graph_triple_limit, config.snippet_limit)
        rows = ask(requests(rows.withColumn("context_text", context), "answer"), backend, ["example_id", "task", "instructions", "prompt", "temperature"], **config.calls())
        rows = rows.withColumn("error", F.coalesce("error", failure("response")))
    rows = failed(answers.with_agent(rows, "response" if answered else None))
    rows = rows.drop("context_text", "task", "instructions", "prompt", "temperature", "response", "response_error")
    return metrics.token_f1(rows, rows.columns, "answer", "answer_text").withColumn("token_f1", rounded(F.col("token_f1")))


def failed(rows: DataFrame) -> DataFrame:
    """``rows`` with what counts for those that have an ``error``: a stand-in answer, no score of extraction or support, one more issue."""
    wrong = F.col("error").isNotNull()
    stand_in = answers.after_error(F.col("error"), F.col("references"), F.col("question_text"))
    taken = {c: F.when(wrong, stand_in[c]).otherwise(F.col(c)) for c in ("answer", "confidence", "quality_notes", "answer_generation_mode")}
    none = {c: F.when(wrong, 0.0).otherwise(F.col(c)) for c in ("extraction_f1", "support_score")}
    return rows.withColumns(taken | none | {"n_issues": F.when(wrong, F.coalesce("n_issues", F.lit(0)) + 1).otherwise(F.col("n_issues"))})


def details(rows: DataFrame, per_baseline: int | None = 25) -> DataFrame:
    """Answer details of each baseline's first examples: (baseline, example_id, answer struct)."""
    kept = rows if per_baseline is None else tables.per_group_limit(rows, per_baseline, ["baseline"], [F.col("example_id")])
    bundle = F.struct("context_mode", "answer_generation_mode", "answer_fallback_reason", "intent_id", "focus_slots", "answerable", "missing_slots", "filled_slots", "missing_requirements", "matched_relations", "matched_entity_types", F.col("sentences").alias("reference_sentences"), "triples")
    answer = F.struct(
        F.col("example_id").alias("question_id"),
        "category",
        F.coalesce("selected_profile", "target_profile").alias("profile_used"),
        F.col("question_text").alias("question"),
        "answer",
        F.col("answer_text").alias("ground_truth_answer"),
        "token_f1",
        "confidence",
        F.transform("triples", lambda t: t["edge_id"]).alias("selected_edge_ids"),
        "quality_notes",
        bundle.alias("evidence_bundle"),
    )
    return kept.select("baseline", "example_id", answer.alias("answer"))


def _applicable(rows: DataFrame) -> DataFrame:
    """The metrics of each row; null where they do not apply to its baseline."""
    chosen = F.col("baseline").isin(GRAPH_BASELINES[1:])
    built = F.col("baseline").isin(GRAPH_BASELINES)
    return rows.select(
        "baseline",
        "example_id",
        F.col("token_f1").alias("answer_quality_score"),
        F.when(chosen, (F.col("selected_profile") == F.col("target_profile")).cast("double")).alias("profile_selection_accuracy"),
        F.when(built, F.col("extraction_f1")).alias("extraction_f1"),
        F.when(built, F.col("support_score")).alias("support_coverage"),
        F.when(built, F.coalesce("n_issues", F.lit(0))).alias("n_issues"),
        "confidence",
    )


METRICS = ("answer_quality_score", "profile_selection_accuracy", "extraction_f1", "support_coverage")


def summary(rows: DataFrame) -> DataFrame:
    """One row a baseline; metrics that do not apply to it are null."""
    table = _applicable(rows).groupBy("baseline").agg(
        F.count(F.lit(1)).alias("n"), *(rounded(F.avg(m)).alias(m) for m in METRICS), rounded(F.avg("confidence")).alias("avg_confidence"), F.sum("n_issues").alias("n_issues")
    )
    table = staged(table, "summary")
    for anchor, name in (("reference_only_baseline", "answer_quality_delta"), ("question_only_baseline", "answer_quality_delta_vs_question_only")):
        delta = metrics.delta_vs(table, anchor, "baseline", ["answer_quality_score"]).select("baseline", rounded(F.col("answer_quality_score_delta")).alias(name))
        table = table.join(delta, "baseline", "left")
    return table


def partial_summary(rows: DataFrame, every: int = 10) -> DataFrame:
    """(baseline, processed, total, metrics so far) after each ``every`` examples and at the end."""
    return metrics.checkpoints(_applicable(rows), ["baseline"], ["example_id"], METRICS, every)

"""The sample pipeline and its evaluator: documents and questions to graph, answers and scores.

All documents build one graph.  What the sample's texts state is given as rules: a rule adds an
entity or relation to documents of its profile that contain its phrase (an empty phrase always
holds), and pattern rules add one entity a match.  ``RuleSet`` holds them, so the engine knows no
company by name.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions.numbers import rounded
from factloom.operators import answers, evidence, graph, metrics, profiles, quality, support
from factloom.operators.extract import ENTITIES, RELATIONS, distinct_entities, entity, relation
from factloom.plans import dims
from factloom.sources import files
from factloom.sources.staging import staged

#: Words that are no part of a person's name, in either place.
STOP = ("Executive", "Board", "Committee", "Return", "Banking")
PATTERNS = {"person": X.PERSON, "money": X.MONEY, "quarter": X.QUARTER}


#: How many values a rule of each kind has.
VALUES = {"entity": 2, "relation": 3, "pattern": 2}


@dataclass(frozen=True)
class RuleSet:
    """rules: profile ("" for any) -> ordered (phrase, kind, values[, cased]): ("entity", (name, type)), ("relation", (s, r, t)) or ("pattern", (pattern, type)).

    A phrase is looked for in lower case, or as it stands where ``cased``.
    """

    rules: Mapping[str, tuple] = field(default_factory=dict)
    entity_confidence: float = 0.88
    relation_confidence: float = 0.84
    dedupe: bool = False
    #: Answers by query template.
    templates: Mapping[str, answers.AnswerTemplate] = field(default_factory=dict)


def rules_of(data: Mapping) -> RuleSet:
    """A rule set from plain data: a list ``rules`` of rows {profile, phrase, kind, values, cased}, in order, and the set's other fields.

    ``templates`` maps query templates to {pattern, confidence}.  Rows that can't be right are refused.
    """
    rules: dict[str, list[tuple]] = {}
    for n, row in enumerate(data.get("rules", ())):
        kind, values, profile = row.get("kind"), tuple(row.get("values") or ()), row.get("profile") or ""
        if kind not in VALUES or len(values) != VALUES[kind] or not all(isinstance(v, str) and v for v in values):
            raise ValueError(f"rule {n}: a rule is an entity (name, type), a relation (source, type, target) or a pattern (pattern, type)")
        if kind == "pattern" and values[0] not in PATTERNS:
            raise ValueError(f"rule {n}: no pattern {values[0]!r}; there are {', '.join(PATTERNS)}")
        if profile and profile not in dims.PROFILES:
            raise ValueError(f"rule {n}: no profile {profile!r}")
        rules.setdefault(profile, []).append((row.get("phrase") or "", kind, values, bool(row.get("cased", False))))
    rest = {name: data[name] for name in ("entity_confidence", "relation_confidence", "dedupe") if name in data}
    templates = {name: answers.AnswerTemplate(t["pattern"], float(t["confidence"])) for name, t in data.get("templates", {}).items()}
    return RuleSet({p: tuple(rows) for p, rows in rules.items()}, templates=templates, **rest)


def read_rules(uri: str) -> RuleSet:
    """The rule set of a JSON file."""
    held = files.read(uri)
    if held is None:
        raise FileNotFoundError(uri)
    return rules_of(json.loads(held))


def _people(text: Column) -> Column:
    stop = F.array(*map(F.lit, STOP))
    return F.filter(X.persons(text, initials=False), lambda p: ~F.arrays_overlap(F.split(p, " "), stop))


def _as_entity(kind: str, confidence: float):
    return lambda name: entity(name, kind, confidence)


def extracted(df: DataFrame, rules: RuleSet, profile: Column) -> DataFrame:
    text, low = F.col("text"), F.lower("text")

    def parts(of: str, kinds: tuple[str, ...], kind: str) -> Column:
        made = [F.array().cast(kind)]
        for phrase, what, values, *cased in rules.rules.get(of, ()):
            if what not in kinds:
                continue
            if what == "pattern":
                found = _people(text) if values[0] == "person" else F.regexp_extract_all(text, F.lit(PATTERNS[values[0]]), 1)
                item = F.transform(found, _as_entity(values[1], rules.entity_confidence))
            elif what == "entity":
                item = F.array(entity(F.lit(values[0]), values[1], rules.entity_confidence))
            else:
                item = F.array(relation(F.lit(values[0]), values[1], F.lit(values[2]), rules.relation_confidence))
            held = F.contains(text, F.lit(phrase)) if any(cased) else F.contains(low, F.lit(phrase.lower()))
            made.append(F.when(held, item).otherwise(F.array()).cast(kind))
        return F.concat(*made)

    def chosen(kinds: tuple[str, ...], kind: str) -> Column:
        if "" in rules.rules:
            return parts("", kinds, kind)
        return F.when(profile == "governance", parts("governance", kinds, kind)).when(profile == "shareholder_return", parts("shareholder_return", kinds, kind)).otherwise(parts("financials", kinds, kind))

    df = df.withColumns({"entities": chosen(("entity", "pattern"), ENTITIES), "relations": chosen(("relation",), RELATIONS)})
    return df.withColumn("entities", distinct_entities(F.col("entities"), fold_case=False)) if rules.dedupe else df


def _rows(df: DataFrame, column: str, graph_id: Column, *more: str) -> DataFrame:
    keys = [graph_id.alias("graph_id"), F.col("ord").alias("doc_ord"), "doc_id", F.col("selected_profile").alias("profile"), *more]
    names = ["graph_id", "doc_ord", "doc_id", "profile", *more, "pos"]
    return df.select(*keys, F.posexplode(column).alias("pos", "_m")).select(*names, "_m.*")


def questions_with_needs(questions: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return questions.select(
        F.lit("sample").alias("graph_id"), "ord", "question_id", "question", "query_template", "target_profile", "ground_truth_answer", F.col("query_template").alias("intent_id"),
        support.required_relations(none, F.col("query_template"), dims.TEMPLATE_RELATIONS).alias("required_relations"), none.alias("required_entity_types"), none.alias("focus_slots"),
    )


@dataclass(frozen=True)
class State:
    decisions: DataFrame
    entities: DataFrame
    relations: DataFrame
    nodes: DataFrame
    edges: DataFrame
    issues: DataFrame
    support: DataFrame


def allowed_relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, r) for p, rs in dims.PROFILES.items() for r in rs], "profile string, relation_type string")


def index(spark: SparkSession, documents: DataFrame, questions: DataFrame, rules: RuleSet, linked: bool = True, gold_profiles: DataFrame | None = None, aliases: Mapping[str, str] | None = None) -> State:
    """Profiles, mentions, graph, quality issues and query support of the sample."""
    if gold_profiles is None:
        decided = profiles.by_section(documents, dims.SECTION_PROFILES)
    else:
        decided = documents.join(gold_profiles.withColumnRenamed("profile", "selected_profile"), "doc_id")
    made = extracted(decided, rules, F.col("selected_profile"))
    entities, relations = (staged(_rows(made, c, F.lit("sample")), c) for c in ("entities", "relations"))
    nodes, edges = (staged(table, "graph") for table in graph.build(entities, relations, linked, aliases))
    issues = staged(quality.analyze(nodes, edges, allowed_relations(spark)), "issues")
    found = staged(support.analyze(questions_with_needs(questions), edges, nodes, {}, edge_ids=True), "support")
    return State(decided, entities, relations, nodes, edges, issues, found)


def _answers(asked: DataFrame, edges: DataFrame, nodes: DataFrame, found: DataFrame, templates: Mapping[str, answers.AnswerTemplate], scaled: Column) -> DataFrame:
    """Answers from each question's supporting edges, best first; ``scaled``: whether support scales the confidence."""
    side = lambda s: nodes.select("graph_id", F.col("node_id").alias(f"{s}_node_id"), F.col("name").alias(f"{s}_name"))
    used = support.supporting_edges(asked, edges)
    for s in ("source", "target"):
        used = used.join(side(s), ["graph_id", f"{s}_node_id"], "left")
    best = used.groupBy("graph_id", "question_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("rank"), "ord", "edge_id", "relation_type", "source_name", "target_name"))).alias("found"))
    df = asked.join(best, ["graph_id", "question_id"], "left").join(found.select("graph_id", "question_id", "support_score", "answerable"), ["graph_id", "question_id"], "left")
    text, sure = answers.by_template(F.col("query_template"), F.col("found"), templates)
    sure = F.when(scaled, answers.scaled_confidence(sure, F.col("support_score"))).otherwise(sure)
    ids = F.coalesce(F.transform("found", lambda e: e["edge_id"]), F.array().cast("array<string>"))
    return df.select("graph_id", "question_id", "target_profile", "ground_truth_answer", text.alias("answer"), rounded(sure).alias("confidence"), ids.alias("selected_edge_ids"), "support_score", "answerable")


def answer(state: State, questions: DataFrame, quality_aware: bool, scale: bool, templates: Mapping[str, answers.AnswerTemplate]) -> DataFrame:
    """(question_id, answer, confidence, selected_edge_ids, ...) of the sample's graph."""
    edges = quality.without_issues(state.edges, state.issues) if quality_aware else state.edges
    return _answers(questions_with_needs(questions), edges, state.nodes, state.support, templates, F.lit(scale)).drop("graph_id")


def reference_answers(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """The first sentence of the last document of the question's profile."""
    by_profile = profiles.by_section(documents, dims.SECTION_PROFILES).groupBy(F.col("selected_profile").alias("target_profile")).agg(F.max_by("text", "ord").alias("text"))
    return questions.join(by_profile, "target_profile").select("question_id", "target_profile", "ground_truth_answer", X.first_sentence(F.col("text")).alias("answer"), F.lit(0.45).alias("confidence"))


def question_answers(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", "target_profile", "ground_truth_answer", F.lit(answers.QUESTION_ONLY).alias("answer"), F.lit(0.12).alias("confidence"))


def evaluate(spark: SparkSession, data: Mapping[str, DataFrame], constrained: RuleSet, unconstrained: RuleSet, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """One row a baseline: answer quality and its delta, profile accuracy, extraction F1, support coverage.

    The baseline is the graph's id, so one plan builds the graphs of all of them.
    """
    documents, questions = data["documents"], data["questions"]
    built = [name for name, flags in dims.BASELINES.items() if flags[0] is not None]
    chosen = [name for name in built if dims.BASELINES[name][0]]
    flag = lambda name, i: F.lit(dims.BASELINES[name][i])
    flags = F.array(*(F.struct(F.lit(n).alias("graph_id"), flag(n, 0).alias("selects"), flag(n, 1).alias("constrained"), flag(n, 2).alias("linked"), flag(n, 3).alias("aware")) for n in built))
    each = F.explode(F.array(*map(F.lit, built)))
    gold = data["gold_profiles"]
    decided = profiles.by_section(documents, dims.SECTION_PROFILES).withColumnRenamed("selected_profile", "by_section").join(gold, "doc_id", "left")
    decided = decided.withColumn("_f", F.explode(flags)).select("*", "_f.*").drop("_f")
    decided = decided.withColumn("selected_profile", F.when(F.col("selects"), F.col("by_section")).otherwise(F.col("profile"))).drop("profile").where("selected_profile IS NOT NULL")
    one = extracted(decided, constrained, F.col("selected_profile")).withColumnsRenamed({"entities": "_e", "relations": "_r"})
    made = extracted(one, unconstrained, F.col("selected_profile"))
    made = staged(made.withColumns({c: F.when(F.col("constrained"), F.col(kept)).otherwise(F.col(c)) for c, kept in (("entities", "_e"), ("relations", "_r"))}).drop("_e", "_r"), "extractions")
    entities, relations = (staged(_rows(made, c, F.col("graph_id"), "linked"), c) for c in ("entities", "relations"))
    nodes, edges = (staged(table, "graph") for table in graph.build(entities, relations, "linked", aliases))
    issues = quality.analyze(nodes, edges, allowed_relations(spark))
    asked = staged(questions_with_needs(questions).drop("graph_id").withColumn("graph_id", each), "questions")
    found = staged(support.analyze(asked, edges, nodes, {}), "support")

    aware = F.col("graph_id").isin(*(n for n in built if dims.BASELINES[n][3]))
    kept = quality.without_issues(edges, issues.where(aware))
    by_graph = _answers(asked, kept, nodes, found, {**unconstrained.templates, **constrained.templates}, aware).withColumnRenamed("graph_id", "baseline")
    plain = [question_answers(questions).withColumn("baseline", F.lit("question_only_baseline")), reference_answers(documents, questions).withColumn("baseline", F.lit("reference_only_baseline"))]
    columns = ["baseline", "question_id", "answer", "ground_truth_answer"]
    every = by_graph.select(columns).unionByName(plain[0].select(columns)).unionByName(plain[1].select(columns))
    scored = metrics.token_f1(staged(every, "answers"), ["baseline", "question_id"], "answer", "ground_truth_answer")
    quality_score = scored.groupBy("baseline").agg(rounded(F.avg(rounded(F.col("token_f1")))).alias("answer_quality_score"))

    e = metrics.set_scores(entities, data["gold_entities"].withColumn("graph_id", each), ["doc_id", "name", "entity_type"], ["graph_id"]).select("graph_id", rounded(F.col("f1")).alias("ef"))
    r = metrics.set_scores(relations, data["gold_relations"].withColumn("graph_id", each), ["doc_id", "source_name", "relation_type", "target_name"], ["graph_id"]).select("graph_id", rounded(F.col("f1")).alias("rf"))
    # No mention on either side is a full score.
    f1 = e.join(r, "graph_id", "full_outer").select(F.col("graph_id").alias("baseline"), rounded((F.coalesce("ef", F.lit(1.0)) + F.coalesce("rf", F.lit(1.0))) / 2).alias("extraction_f1"))
    right = gold.withColumn("graph_id", each).join(decided.select("graph_id", "doc_id", "selected_profile"), ["graph_id", "doc_id"], "left").where(F.col("graph_id").isin(*chosen))
    accuracy = metrics.accuracy(right, "selected_profile", "profile", "graph_id").select(F.col("graph_id").alias("baseline"), rounded(F.col("accuracy")).alias("profile_selection_accuracy"))
    coverage = found.groupBy(F.col("graph_id").alias("baseline")).agg(rounded(F.avg("support_score")).alias("support_coverage"))
    table = spark.createDataFrame(list(enumerate(dims.BASELINES)), "place int, baseline string")
    for other in (quality_score, accuracy, f1, coverage):
        table = table.join(other, "baseline", "left")
    table = staged(table, "summary")
    delta = metrics.delta_vs(table, "reference_only_baseline", "baseline", ["answer_quality_score"])
    delta = delta.select("baseline", F.when(F.col("baseline") != "question_only_baseline", rounded(F.col("answer_quality_score_delta"))).alias("answer_quality_delta"))
    return table.join(delta, "baseline")


def provenance(state: State, questions: DataFrame, documents: DataFrame) -> DataFrame:
    """The best sentence for each supporting edge of a question."""
    names = state.nodes.select("graph_id", "node_id", "name")
    side = lambda s: names.withColumnsRenamed({"node_id": f"{s}_node_id", "name": f"{s}_name"})
    used = support.supporting_edges(questions_with_needs(questions), state.edges).join(side("source"), ["graph_id", "source_node_id"]).join(side("target"), ["graph_id", "target_node_id"])
    rows = evidence.sentence_rows(documents.select(F.col("doc_id").alias("source_doc_id"), F.array("text").alias("references")), ["source_doc_id"])
    return evidence.snippets(used, rows, "source_doc_id")

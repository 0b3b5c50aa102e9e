"""How well a graph supports questions: matched relations, entity types and slots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required_relations(own: Column, template: Column, templates: Mapping[str, Sequence[str]]) -> Column:
    """A question's own list, else its template's, else none."""
    known = F.create_map(*(x for name, rels in templates.items() for x in (F.lit(name), F.array(*map(F.lit, rels)))))
    none = F.array().cast("array<string>")
    return F.when(F.size(F.coalesce(own, none)) > 0, own).otherwise(F.coalesce(known[template], none))


def supporting_edges(questions: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, question_id, edge columns): edges of the target profile with a required relation.

    An equi-join after exploding the few required relations, never a test on arrays.
    """
    wanted = questions.select("graph_id", "question_id", F.col("target_profile").alias("profile"), F.explode(F.array_distinct("required_relations")).alias("relation_type"))
    return wanted.join(edges, ["graph_id", "profile", "relation_type"])


def _hint_slots(intent: Column, joined: Column, hints: Mapping[str, Mapping[str, Sequence[str]]]) -> Column:
    """Slots of the question's intent with a hint inside the joined text."""
    found = F.array().cast("array<string>")
    for name, slots in hints.items():
        hit = [F.when(reduce(lambda a, b: a | b, (F.contains(joined, F.lit(h)) for h in words)), F.lit(slot)) for slot, words in slots.items()]
        found = F.when(intent == name, F.array_compact(F.array(*hit))).otherwise(found)
    return found


def own_hint_slots(slots: Column, hints: Column, joined: Column) -> Column:
    """Slots of an intent without rules: those with one of the question's own hints in the joined text."""
    return F.filter(slots, lambda s: F.exists(F.coalesce(hints[s], F.array().cast("array<string>")), lambda h: F.contains(joined, h)))


def analyze(questions: DataFrame, edges: DataFrame, nodes: DataFrame, hints: Mapping[str, Mapping[str, Sequence[str]]], edge_ids: bool = False) -> DataFrame:
    """Support of each question (graph_id, question_id, target_profile, intent_id, required_relations,
    required_entity_types, focus_slots[, focus_slot_hints]).

    Requirements are relations, entity types and slots, in this order; the score is the matched
    share.  Without requirements it is 0 and the question counts as answerable.  A hint is looked
    for in the words of one edge.

    Edges stay rows: they are summed up by question and source node, then by question, into sets of
    types and slots, which are short.  Only ``edge_ids`` lists the edges of a question, in order.
    """
    ends = nodes.select("graph_id", "node_id", F.col("name"), F.col("entity_type"))
    side = lambda s: ends.withColumnsRenamed({"node_id": f"{s}_node_id", "name": f"{s}_name", "entity_type": f"{s}_type"})
    none = F.array().cast("array<string>")
    own_hints = F.col("focus_slot_hints") if "focus_slot_hints" in questions.columns else F.lit(None).cast("map<string, array<string>>")
    asked = questions.select("graph_id", "question_id", F.col("intent_id").alias("_intent"), F.coalesce("focus_slots", none).alias("_slots"), own_hints.alias("_hints"))
    used = supporting_edges(questions, edges).join(side("source"), ["graph_id", "source_node_id"], "left").join(side("target"), ["graph_id", "target_node_id"], "left")
    used = used.join(asked, ["graph_id", "question_id"])
    words = F.array_join(F.array_compact(F.array(F.lower("source_name"), F.lower("target_name"), F.lower("relation_type"))), " ")
    slots = F.when(F.col("_intent").isin(*hints), _hint_slots(F.col("_intent"), words, hints)).otherwise(own_hint_slots(F.col("_slots"), F.col("_hints"), words))
    role, period = F.col("relation_type") == "holds_role", F.when(F.col("relation_type") == "reported_for_period", F.col("target_node_id"))
    by_node = used.groupBy("graph_id", "question_id", "source_node_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set("relation_type").alias("relations"),
        F.array_union(F.collect_set("source_type"), F.collect_set("target_type")).alias("types"),
        F.collect_set(slots).alias("slots"),
        F.count_if(role & (F.col("source_type") == "Person")).alias("held"),
        F.bool_or(role & (F.col("target_type") == "OfficerRole")).alias("role_held"),
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
    )
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    facts = by_node.groupBy("graph_id", "question_id").agg(
        F.sum("n").alias("n_edges"),
        union("relations").alias("matched_relations"),
        union("types").alias("matched_entity_types"),
        F.array_distinct(F.flatten(F.flatten(F.collect_set("slots")))).alias("slots"),
        F.max("held").alias("held"),  # of one person
        F.bool_or("role_held").alias("role_held"),
        (F.min("first_period") != F.max("last_period")).alias("two_periods"),
    )
    if edge_ids:
        listed = used.groupBy("graph_id", "question_id").agg(F.array_sort(F.collect_list(F.struct("ord", "edge_id"))).alias("found"))
        facts = facts.join(listed, ["graph_id", "question_id"], "left")
    df = questions.join(facts, ["graph_id", "question_id"], "left")
    df = df.withColumns({c: F.coalesce(c, none) for c in ("matched_relations", "matched_entity_types", "required_relations", "required_entity_types", "focus_slots", "slots")})
    person = F.array_compact(F.array(F.when(F.col("held") > 0, F.lit("person")), F.when(F.col("role_held"), F.lit("current_role")), F.when(F.col("held") > 1, F.lit("prior_role"))))
    both = F.when((F.col("intent_id") == "financials_metric_delta") & F.col("two_periods"), F.array(F.lit("current_period"), F.lit("prior_period"))).otherwise(none)
    filled = F.when(F.col("intent_id") == "governance_role_transition", person).otherwise(F.array_union("slots", both))
    df = df.withColumn("filled_slots", F.array_sort(filled))
    named = lambda prefix, items: F.transform(items, lambda x: F.concat(F.lit(prefix), x))
    needs = F.concat(named("relation:", "required_relations"), named("entity_type:", "required_entity_types"), named("slot:", "focus_slots"))
    has = F.concat(named("relation:", "matched_relations"), named("entity_type:", "matched_entity_types"), named("slot:", "filled_slots"))
    df = df.withColumns({"requirements": needs, "has": has})
    matched = F.size(F.array_intersect("requirements", "has"))
    ids = [F.coalesce(F.transform("found", lambda f: f["edge_id"]), none).alias("supporting_edge_ids")] if edge_ids else []
    return df.select(
        "graph_id",
        "question_id",
        "target_profile",
        "intent_id",
        F.coalesce(F.try_divide(matched, F.size("requirements")), F.lit(0.0)).alias("support_score"),
        F.forall("requirements", lambda r: F.array_contains("has", r)).alias("answerable"),
        F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"),
        *ids,
        F.filter("requirements", lambda r: ~F.array_contains("has", r)).alias("missing_requirements"),
        "matched_relations",
        "matched_entity_types",
        "filled_slots",
    )


def missing_slots(missing: Column) -> Column:
    return F.transform(F.filter(missing, lambda r: F.startswith(r, F.lit("slot:"))), lambda r: F.substring(r, F.lit(6), F.length(r)))

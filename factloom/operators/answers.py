"""Answers by template, from references, and from graph evidence."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import rounded
from factloom.functions.text import confidence, lenient_json, relation_phrase, truncated
from factloom.plans import dims

# They must be these for right results.
QUESTION_ONLY = "Insufficient context to answer without supporting reference evidence."
NO_EVIDENCE = "Insufficient high-quality graph evidence to answer the question."
NO_TEMPLATE = "A graph answer was produced, but no tutorial template matched the question."
# End of fixed values; so are the sentences of ``from_bundle``, ``shared`` and ``context``.


def scaled_confidence(base: Column, support: Column) -> Column:
    """A confidence times its support, a quarter at least."""
    return base * F.greatest(F.lit(0.25), F.coalesce(support, F.lit(1.0)))


def graph_confidence(n_edges: Column, support: Column) -> Column:
    base = F.lit(0.55) + F.least(n_edges, F.lit(3)) * F.lit(0.1)
    return rounded(F.least(scaled_confidence(base, support), F.lit(0.92)))


@dataclass(frozen=True)
class AnswerTemplate:
    """Text with places like {relation.source} or {relation.target}: the names of those edges, in order, with commas."""

    pattern: str
    confidence: float


def by_template(template: Column, found: Column, templates: Mapping[str, AnswerTemplate]) -> tuple[Column, Column]:
    """(answer, confidence) of selected edges ``found``: array of (relation_type, source_name, target_name), best first."""

    def names(relation: str, side: str) -> Column:
        of = F.filter(found, lambda e: (e["relation_type"] == relation) & e[f"{side}_name"].isNotNull())
        return F.array_join(F.transform(of, lambda e: e[f"{side}_name"]), ", ")

    def filled(pattern: str) -> Column:
        parts = re.split(r"\{(\w+)\.(source|target)\}", pattern)
        return F.concat(*(F.lit(parts[i]) if i % 3 == 0 else names(parts[i], parts[i + 1]) for i in range(len(parts)) if i % 3 < 2))

    none = F.coalesce(F.size(found), F.lit(0)) <= 0
    answer, sure = F.when(none, NO_EVIDENCE), F.when(none, 0.2)
    for name, rule in templates.items():
        answer, sure = answer.when(template == name, filled(rule.pattern)), sure.when(template == name, rule.confidence)
    return answer.otherwise(NO_TEMPLATE), sure.otherwise(0.5)


def from_bundle(triples: Column, missing: Column) -> Column:
    """Text of up to four triples, two snippets, and the slots that the graph does not ground."""
    listed = F.array_join(missing, ", ")
    lacking = F.size(missing) > 0
    first = F.slice(triples, 1, 4)
    facts = F.array_join(F.transform(first, lambda t: F.concat_ws(" ", t["source_name"], relation_phrase(t["relation_type"], dims.RELATION_PHRASES), t["target_name"])), "; ")
    quotes = F.array_distinct(F.slice(F.flatten(F.transform(first, lambda t: t["provenance_snippets"])), 1, 2))
    full = F.concat_ws(
        " ",
        F.concat(F.lit("Graph-grounded evidence indicates: "), facts, F.lit(".")),
        F.when(F.size(quotes) > 0, F.concat(F.lit("Supporting reference text: "), F.array_join(quotes, " "), F.lit("."))),
        F.when(lacking, F.concat(F.lit("Missing graph support for: "), listed, F.lit("."))),
    )
    bare = F.when(lacking, F.concat(F.lit("Graph evidence does not ground the required slots for this question. Missing slots: "), listed, F.lit("."))).otherwise("Graph evidence does not provide grounded triples for this question.")
    return F.when(F.size(F.coalesce(triples, F.array())) > 0, full).otherwise(bare)


def shared(mode: Column, sentences: Column, triples: Column, missing: Column) -> tuple[Column, Column]:
    """(answer, confidence) of the answerer that all contexts share, without a model."""
    none = F.array().cast("array<string>")
    lines = F.filter(F.transform(F.coalesce(sentences, none), lambda s: F.trim(s)), lambda s: s != "")
    quoted = F.when(F.size(lines) > 0, F.array_join(F.slice(lines, 1, 2), " ")).otherwise("Reference context did not provide grounded answer text.")
    facts = F.array_join(F.transform(F.slice(triples, 1, 3), lambda t: F.concat_ws(" ", t["source_name"], F.replace(t["relation_type"], F.lit("_"), F.lit(" ")), t["target_name"])), "; ")
    lacking = F.concat(F.lit("Graph evidence is incomplete. Missing slots: "), F.array_join(missing, ", "), F.lit("."))
    empty = F.when(F.size(missing) > 0, lacking).otherwise("Graph evidence did not provide grounded triples for this question.")
    has = F.coalesce(F.size(triples) > 0, F.lit(False))
    graph = F.when(has, F.concat(F.lit("Graph-grounded evidence: "), facts, F.lit("."))).otherwise(empty)
    answer = F.when(mode == "question_only", "Insufficient grounded context to answer from the question alone.").when(mode == "reference_only", quoted).otherwise(graph)
    sure = F.when(mode == "question_only", 0.12).when(mode == "reference_only", 0.35).when(has, 0.42).otherwise(0.18)
    return answer, sure


def _section(title: str, lines: Column) -> Column:
    """A heading and its lines; no lines read ``- None``."""
    return F.concat(F.lit(f"[{title}]\n"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("- None"))


def context(mode: Column, question: Column, intent: Column, sentences: Column, triples: Column, missing: Column, budget: int = 2200, sentence_limit: int = 4, triple_limit: int = 5, snippet_limit: int = 3) -> Column:
    """The text of a question's context that a model would read, cut to the budget."""
    none = F.array().cast("array<string>")
    dashed = lambda items: F.transform(F.filter(F.transform(F.coalesce(items, none), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.concat(F.lit("- "), x))
    head = lambda name: F.concat(F.lit("[Question]\n"), F.trim(question), F.lit(f"\n\n[Context Mode]\n{name}\n\n"))
    used = F.slice(triples, 1, triple_limit)
    named = lambda t, end: F.concat(t[f"{end}_name"], F.lit(" ("), t[f"{end}_type"], F.lit(")"))
    things = F.array_sort(F.array_distinct(F.flatten(F.transform(used, lambda t: F.array(named(t, "source"), named(t, "target"))))))
    links = F.transform(used, lambda t: F.concat(named(t, "source"), F.lit(" --"), t["relation_type"], F.lit("--> "), named(t, "target"), F.lit(" [confidence="), t["confidence"].cast("string"), F.lit("]")))
    quotes = F.slice(F.flatten(F.transform(used, lambda t: F.slice(t["provenance_snippets"], 1, snippet_limit))), 1, snippet_limit)
    graph = F.concat_ws(
        "\n\n",
        F.concat(head("graph_evidence_bundle"), F.lit("[Intent]\n"), intent),
        _section("Entities", F.coalesce(dashed(things), none)),
        _section("Triples", F.coalesce(dashed(links), none)),
        _section("Provenance Snippets", F.coalesce(dashed(quotes), none)),
        _section("Missing Slots", dashed(missing)),
    )
    plain = F.concat(head("question_only"), F.lit("[Available Context]\nNo supporting evidence beyond the question text."))
    reference = F.concat(head("reference_only"), _section("Reference Sentences", F.slice(dashed(sentences), 1, sentence_limit)))
    return truncated(F.when(mode == "question_only", plain).when(mode == "reference_only", reference).otherwise(graph), budget)


def first_reference(references: Column, question: Column, length: int = 400) -> Column:
    """The head of the first reference, or the question."""
    return F.when(F.size(references) > 0, F.substring(F.get(references, F.lit(0)), 1, length)).otherwise(question)


def after_error(error: Column, references: Column, question: Column) -> Column:
    """What stands in for an answer where a row's run failed: null where ``error`` is."""
    note = F.concat(F.lit("Runtime exception fallback: "), error)
    return F.when(
        error.isNotNull(),
        F.struct(first_reference(references, question).alias("answer"), F.lit(0.08).alias("confidence"), F.array(note).alias("quality_notes"), F.lit("runtime_error_fallback").alias("answer_generation_mode")),
    )


def with_agent(df: DataFrame, response: str | None, heuristic_only: bool = False) -> DataFrame:
    """Takes the answer of a model where it can be read, else the row's own (answer, confidence, quality_notes).

    Adds ``answer_generation_mode`` and ``answer_fallback_reason``; ``response`` names the column with
    the model's JSON (its error stands in ``<response>_error``), None if no model was asked.
    """
    notes = F.coalesce("quality_notes", F.array().cast("array<string>")) if "quality_notes" in df.columns else F.array().cast("array<string>")
    if response is None or heuristic_only:
        mode = "heuristic_synthesis_baseline" if heuristic_only else "heuristic_local"
        return df.withColumns({"quality_notes": notes, "answer_generation_mode": F.lit(mode), "answer_fallback_reason": F.lit(None).cast("string")})
    parsed = lenient_json(F.col(response), "answer string, confidence string, quality_notes string")
    text = F.trim(parsed["answer"])
    good = F.coalesce(text != "", F.lit(False))
    listed = F.from_json(parsed["quality_notes"], "array<string>")
    said = F.filter(F.coalesce(listed, F.array(parsed["quality_notes"])), lambda n: F.coalesce(F.trim(n) != "", F.lit(False)))
    reason = F.coalesce(F.col(f"{response}_error"), F.lit("missing worker result"))
    fallback = F.array(F.concat(F.lit("Answer agent fallback used: "), reason))
    return df.withColumns(
        {
            "answer": F.when(good, text).otherwise(F.col("answer")),
            "confidence": F.when(good, confidence(F.coalesce(parsed["confidence"], F.lit("0.4")))).otherwise(F.col("confidence")),
            "quality_notes": F.concat(notes, F.when(good, F.coalesce(said, F.array().cast("array<string>"))).otherwise(fallback)),
            "answer_generation_mode": F.when(good, "openai_answer_agent").otherwise("heuristic_answer_fallback"),
            "answer_fallback_reason": F.when(~good, reason),
        }
    )

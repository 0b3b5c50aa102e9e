"""Sources: question-answer examples, sample and gold JSON, run artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.tables import category_filter, head_after_groups, per_group_limit

# The columns that a source must have, and the categories kept.
REQUIRED = ("_id", "text", "reasoning", "category", "references", "answer", "type")
CATEGORIES = ("financials", "governance", "shareholder return")

_ENTITY = "struct<name: string, entity_type: string>"
_RELATION = "struct<source_name: string, relation_type: string, target_name: string>"
SAMPLE_SCHEMA = (
    "documents array<struct<doc_id: string, section_type: string, text: string>>, "
    "questions array<struct<question_id: string, question: string, query_template: string, target_profile: string, ground_truth_answer: string>>, "
    f"gold_profiles map<string, string>, gold_extractions map<string, struct<entities: array<{_ENTITY}>, relations: array<{_RELATION}>>>"
)
GOLD_SCHEMA = f"examples array<struct<example_id: string, category: string, gold_profile: string, intent_id: string, required_answer_slots: array<string>, preferred_answer_evidence: array<string>, gold_entities: array<{_ENTITY}>, gold_relations: array<{_RELATION}>>>"


def require(df: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def load_examples(source: DataFrame, per_category: int | None = 25, sample: int | None = None, max_references: int = 2, only: DataFrame | None = None, order: str = "_id") -> DataFrame:
    """Examples of the kept categories: limits by category in order of ``order``, then a head over all.

    ``only`` restricts to its ``_id`` values (those with manual gold).  Null references are none.
    """
    df = category_filter(require(source), "category", CATEGORIES)
    if only is not None:
        df = df.join(only.select("_id").distinct(), "_id", "left_semi")
    df = df.withColumn("_cat", F.trim(F.regexp_replace(F.lower("category"), r"\s+", " ")))
    if sample is not None:
        df = head_after_groups(df, per_category or 2**31 - 1, sample, "_cat", [order])
    elif per_category is not None:
        df = per_group_limit(df, per_category, ["_cat"], [F.col(order)])
    references = F.slice(F.coalesce("references", F.array().cast("array<string>")), 1, max_references)
    profile = F.replace(F.col("_cat"), F.lit(" "), F.lit("_"))
    question, answer = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("answer").cast("string"), F.lit(""))
    joined = F.when(F.size(references) > 0, F.array_join(references, "\n\n")).otherwise(question)
    return df.select(
        F.col("_id").cast("string").alias("example_id"),
        "category",
        question.alias("question_text"),
        answer.alias("answer_text"),
        references.alias("references"),
        F.coalesce(F.col("reasoning").cast("boolean"), F.lit(False)).alias("reasoning"),
        F.col("type").cast("string").alias("question_type"),
        profile.alias("target_profile"),
        joined.alias("source_text"),
    )


def sample_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """documents, questions, gold_profiles, gold_entities, gold_relations of a sample JSON file, with ordinals."""
    raw = spark.read.schema(SAMPLE_SCHEMA).option("multiLine", True).json(path)
    rows = lambda c: raw.select(F.posexplode(c).alias("ord", "x")).select("ord", "x.*")
    gold = raw.select(F.explode("gold_extractions").alias("doc_id", "x"))
    part = lambda c: gold.select("doc_id", F.posexplode(f"x.{c}").alias("pos", "m")).select("doc_id", "pos", "m.*")
    return {
        "documents": rows("documents"),
        "questions": rows("questions"),
        "gold_profiles": raw.select(F.explode("gold_profiles").alias("doc_id", "profile")),
        "gold_entities": part("entities"),
        "gold_relations": part("relations"),
    }


def manual_gold(spark: SparkSession, path: str | None) -> DataFrame:
    """Manual gold examples; no path gives none; null lists are empty."""
    raw = spark.read.schema(GOLD_SCHEMA).option("multiLine", True).json(path) if path else spark.createDataFrame([], GOLD_SCHEMA)
    df = raw.select(F.explode("examples").alias("x")).select("x.*")
    lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    return df.withColumns({c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in lists})


def artifacts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Per-example artifacts of a run: JSON files below folder/baseline=..., with the file they come from."""
    return spark.read.schema(schema).json(folder).withColumn("file", F.col("_metadata.file_path"))

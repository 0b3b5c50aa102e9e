"""Profile selection and intent inference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import keyword_score


def first_highest(scores: Mapping[str, Column]) -> Column:
    """Struct (name, score) of the highest score, ties to the first name given."""
    ranked = [F.struct(score.alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, score) in enumerate(scores.items())]
    return F.greatest(*ranked) if len(ranked) > 1 else ranked[0]


def by_section(df: DataFrame, sections: Mapping[str, str], section: str = "section_type", default: str = "financials") -> DataFrame:
    """Profile of a section; known sections are strict, others fall back."""
    known = F.create_map(*(F.lit(x) for pair in sections.items() for x in pair))[F.lower(F.trim(section))]
    chosen = F.coalesce(known, F.lit(default))
    # An array of the chosen profile and the default, without saying one twice.
    candidates = F.array_distinct(F.array(chosen, F.lit(default)))
    return df.withColumns(
        {
            "selected_profile": chosen,
            "candidate_profiles": candidates,
            "confidence": F.when(known.isNotNull(), 0.9).otherwise(0.55),
            "mapping_policy": F.when(known.isNotNull(), "strict").otherwise("soft"),
        }
    )


def by_keywords(df: DataFrame, text: Column, keywords: Mapping[str, Sequence[str]], fallback: Column) -> DataFrame:
    """Profile with the most keywords in the text; without any, the fallback."""
    lowered = F.lower(text)
    best = first_highest({name: keyword_score(lowered, words) for name, words in keywords.items()})
    df = df.withColumn("_best", best)
    score = F.col("_best.score")
    return df.withColumns(
        {
            "selected_profile": F.when(score > 0, F.col("_best.name")).otherwise(fallback),
            "profile_score": score,
            "confidence": F.least(F.lit(0.6) + F.least(score, F.lit(4)) * F.lit(0.1), F.lit(0.95)),
        }
    ).drop("_best")


def intent(profile: Column, text: Column, intents: Mapping[str, Mapping[str, tuple]], defaults: Mapping[str, str]) -> Column:
    """Intent of a profile with the most triggers in the text; without any, the profile's default."""
    lowered, found = F.lower(text), None
    for name, specs in intents.items():
        best = first_highest({i: keyword_score(lowered, spec[0]) for i, spec in specs.items()})
        here = F.when(best["score"] > 0, best["name"]).otherwise(F.lit(defaults[name]))
        found = F.when(profile == name, here) if found is None else found.when(profile == name, here)
    return found

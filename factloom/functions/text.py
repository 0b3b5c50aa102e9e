"""Column functions on text: normal forms, keyword tests, sentences, mentions, lenient parsing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.numbers import rounded

# They must be these for right results.
PERSON = r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b"
PERSON_WITH_INITIAL = r"\b([A-Z][a-z]+(?: [A-Z]\.)? [A-Z][a-z]+)\b"
MONEY = r"(USD [0-9]+(?:\.[0-9]+)?(?: billion| million)?)"
LOOSE_MONEY = r"(?i)(?:USD\s*)?\$?\s?\d+(?:\.\d+)?\s?(?:billion|million|thousand|%)?"
QUARTER = r"\b(Q[1-4] 20[0-9]{2})\b"
YEAR = r"\b(?:FY)?20\d{2}\b"
LOOSE_QUARTER = r"(?i)\bQ[1-4]\s?20\d{2}\b"
COMPANY = r"([A-Z][A-Za-z&., ]+(?:Inc\.|Corporation|Corp\.|Company|Markets|Holdings))"
#: All white space, not only that of ASCII.
WHITE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
SENTENCE_END = rf"(?<=[.!?]){WHITE}+(?=[A-Z0-9])"
FIRST_STOP = rf"(?<=[\p{{L}}\p{{N}}_])\.{WHITE}+(?=[A-Z])"
TRUNCATED = "\n\n[Truncated]\nContext truncated to the shared answer-context budget."
# End of fixed values.


def stripped(text: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def normalize(text: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(normalize(text), F.lit("")), " "), lambda x: x != "")


def slug(text: Column) -> Column:
    """Lower case with underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{WHITE}+", " "))


def keyword_score(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords the text contains, as substrings."""
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), stripped), lambda s: s != "")


def first_sentence(text: Column) -> Column:
    """Up to the first full stop that a capital follows, with its full stop; an empty text stays empty."""
    head = stripped(F.split(text, FIRST_STOP, 2)[0])
    return F.when(F.endswith(head, F.lit(".")) | (head == ""), head).otherwise(F.concat(head, F.lit(".")))


def first_of_each(values: Column, key: Callable[[Column], Column] = F.lower) -> Column:
    """Of values with equal keys the first, in order of appearance: sorted by key, so long arrays take no quadratic time."""

    def firsts(ranked: Column) -> Column:
        kept = F.filter(ranked, lambda x, i: (i == 0) | ~F.get(ranked, i - 1)["key"].eqNullSafe(x["key"]))
        return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["at"].alias("at"), x["value"].alias("value")))), lambda x: x["value"])

    ranked = F.array_sort(F.transform(values, lambda v, i: F.struct(key(v).alias("key"), i.alias("at"), v.alias("value"))))
    # A lambda binds the sorted array, which would else be sorted again for each element.
    return F.get(F.transform(F.array(ranked), firsts), F.lit(0))


def persons(text: Column, initials: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(PERSON_WITH_INITIAL if initials else PERSON), 1)


def amounts(text: Column) -> Column:
    """Loose amounts of at least two characters, first of each."""
    found = F.transform(F.regexp_extract_all(text, F.lit(LOOSE_MONEY), 0), collapsed)
    return first_of_each(F.filter(found, lambda a: F.length(a) >= 2))


def periods(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(YEAR), 0), F.regexp_extract_all(text, F.lit(LOOSE_QUARTER), 0))))


def company(text: Column) -> Column:
    """The first company name, or null.

    The pattern tries every capital up to the end of its run, so texts without any of the endings are left out first.
    """
    ending = COMPANY[COMPANY.index("(?:") : -1]
    return F.when(F.regexp_like(text, F.lit(ending)), collapsed(F.nullif(F.regexp_extract(text, COMPANY, 1), F.lit(""))))


def truncated(text: Column, budget: int) -> Column:
    """Cut to a budget of characters at a blank, with a marker."""
    short = F.trim(F.regexp_replace(text, "\n{3,}", "\n\n"))
    clip = F.rtrim(F.substring(short, 1, budget))
    return F.when(F.length(short) <= budget, short).otherwise(F.concat(F.regexp_replace(clip, " [^ ]*$", ""), F.lit(TRUNCATED)))


def lenient_json(text: Column, schema: str) -> Column:
    """Parsed JSON; if the whole is none, the outermost braces."""
    options = {"mode": "PERMISSIVE"}
    whole = F.when(F.trim(text).startswith("{"), F.from_json(text, schema, options))
    return F.coalesce(whole, F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema, options))


def confidence(text: Column) -> Column:
    """A confidence in words, as a number or in percent, as 0 to 1."""
    word = F.lower(F.trim(text))
    number = F.regexp_extract(word, r"\d+(?:\.\d+)?", 0).try_cast("double")
    scaled = F.when((number > 1) & (number <= 100), number / 100).otherwise(number)
    return (
        F.when(word.isin("high", "very high"), 0.85)
        .when(word.isin("medium", "moderate"), 0.6)
        .when(word.isin("low", "very low"), 0.3)
        .when(number.isNull(), 0.4)
        .otherwise(rounded(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))))
    )


def relation_phrase(relation: Column, phrases: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for pair in phrases.items() for x in pair))
    return F.coalesce(known[relation], F.replace(relation, F.lit("_"), F.lit(" ")))

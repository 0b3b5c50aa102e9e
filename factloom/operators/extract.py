"""Heuristic extraction of entities and relations as array columns, and their rows.

Each extractor gives (entities, relations): arrays in the order that later steps rely on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.plans import dims

ENTITIES = "array<struct<name: string, entity_type: string, confidence: double>>"
RELATIONS = "array<struct<source_name: string, relation_type: string, target_name: string, confidence: double>>"
MODEL_ANSWER = "entities array<struct<name: string, entity_type: string>>, relations array<struct<source_name: string, relation_type: string, target_name: string>>"
ENTITY_CONFIDENCE, RELATION_CONFIDENCE = 0.74, 0.71


def entity(name: Column, kind: str | Column, confidence: float = ENTITY_CONFIDENCE) -> Column:
    return F.struct(name.alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("entity_type"), F.lit(confidence).alias("confidence"))


def relation(source: Column, kind: str, target: Column, confidence: float = RELATION_CONFIDENCE) -> Column:
    return F.struct(source.alias("source_name"), F.lit(kind).alias("relation_type"), target.alias("target_name"), F.lit(confidence).alias("confidence"))


def _if(condition: Column, item: Column) -> Column:
    return F.when(condition, F.array(item))


def _concat(parts: Sequence[Column], kind: str) -> Column:
    return F.concat(*(F.coalesce(p, F.array()).cast(kind) for p in parts))


def distinct_entities(items: Column, fold_case: bool = True) -> Column:
    """The first of each (name, type); ``fold_case``: whatever the name's case."""
    return X.first_of_each(items, lambda e: F.struct((F.lower(e["name"]) if fold_case else e["name"]).alias("name"), e["entity_type"].alias("entity_type")))


def distinct_relations(items: Column) -> Column:
    return X.first_of_each(items, lambda r: F.struct(F.lower(r["source_name"]).alias("s"), r["relation_type"].alias("r"), F.lower(r["target_name"]).alias("t")))


def _title(name: str) -> str:
    return name.title() if name.islower() else name


def prepared(df: DataFrame, text: str) -> DataFrame:
    """Adds what the extractors share, worked out once a row: lower case, company, people, periods, amounts."""
    t = F.col(text)
    return df.withColumns(
        {
            "_low": F.lower(t),
            "_company": F.coalesce(X.company(t), F.lit("Referenced Company")),
            "_people": X.first_of_each(X.persons(t)),
            "_periods": X.periods(t),
            "_amounts": X.amounts(t),
        }
    )


SHARED = ("_low", "_company", "_people", "_periods", "_amounts")


def governance() -> tuple[Column, Column]:
    low, company, people = F.col("_low"), F.col("_company"), F.col("_people")
    has = lambda k: F.contains(low, F.lit(k.lower()))
    entities = [F.array(entity(company, "LegalEntity"))]
    entities += [_if(has(c), entity(F.lit(c.title()), "Committee" if "committee" in c else "Board")) for c in dims.COMMITTEES]
    entities.append(F.transform(people, lambda p: entity(p, "Person")))
    entities += [_if(has(r), entity(F.lit(_title(r)), "OfficerRole")) for r in dims.ROLES]
    someone = F.size(people) > 0
    first = F.get(people, F.lit(0))
    relations = [_if(has(r) & someone, relation(first, "holds_role", F.lit(_title(r)))) for r in dims.ROLES]
    relations.append(_if(has("chair") & someone, relation(first, "chairs", F.lit("Board"))))
    committee = F.when(has("audit committee"), "Audit Committee").otherwise("Committee")
    relations.append(F.when(has("committee"), F.transform(F.slice(people, 1, 3), lambda p: relation(p, "serves_on_committee", committee))))
    return _concat(entities, ENTITIES), _concat(relations, RELATIONS)


def financials() -> tuple[Column, Column]:
    low, company = F.col("_low"), F.col("_company")
    has = lambda k: F.contains(low, F.lit(k))
    metric = F.coalesce(*(F.when(has(m), F.lit(_title(m))) for m in dims.METRICS))
    segments = F.array_compact(F.array(*(F.when(has(s), F.lit(s.title())) for s in dims.SEGMENTS)))
    periods, amounts = F.col("_periods"), F.col("_amounts")
    entities = [
        F.array(entity(company, "LegalEntity")),
        _if(metric.isNotNull(), entity(metric, "FinancialMetric")),
        F.transform(segments, lambda s: entity(s, "BusinessSegment")),
        F.transform(F.slice(periods, 1, 3), lambda p: entity(F.upper(p), "ReportingPeriod")),
        F.transform(F.slice(amounts, 1, 6), lambda a: entity(a, "MonetaryAmount")),
    ]
    relations = [
        _if(metric.isNotNull(), relation(company, "reports_metric", metric)),
        _if(metric.isNotNull() & (F.size(periods) > 0), relation(metric, "reported_for_period", F.get(periods, F.lit(0)))),
        _if((F.size(segments) > 0) & (F.size(amounts) > 0), relation(F.get(segments, F.lit(0)), "segment_contribution", F.get(amounts, F.lit(0)))),
    ]
    return _concat(entities, ENTITIES), _concat(relations, RELATIONS)


def shareholder_return() -> tuple[Column, Column]:
    low, company = F.col("_low"), F.col("_company")
    has = lambda k: F.contains(low, F.lit(k))
    bought, dividend = has("repurchase") | has("buyback"), has("dividend")
    shares = F.when(has("common stock"), "Common Stock").when(has("common share"), "Common Share")
    program = F.lit("Share Repurchase Program")
    entities = [
        F.array(entity(company, "LegalEntity")),
        _if(bought, entity(program, "RepurchaseProgram")),
        _if(dividend, entity(F.lit("Dividend"), "Dividend")),
        _if(shares.isNotNull(), entity(shares, "ShareClass")),
        F.transform(F.slice("_amounts", 1, 5), lambda a: entity(a, "MonetaryAmount")),
    ]
    relations = [
        _if(bought, relation(company, "announced_repurchase", program)),
        _if(dividend, relation(company, "declared_dividend", F.lit("Dividend"))),
        _if(dividend & shares.isNotNull(), relation(F.lit("Dividend"), "applies_to_share_class", shares)),
    ]
    return _concat(entities, ENTITIES), _concat(relations, RELATIONS)


EXTRACTORS = {"governance": governance, "financials": financials, "shareholder_return": shareholder_return}


def extract(df: DataFrame, text: str = "source_text", profile: str = "selected_profile", names: tuple[str, str] = ("entities", "relations"), keep: bool = False) -> DataFrame:
    """Adds entities and relations (``names``) by each row's profile; unknown profiles go to financials.

    What ``prepared`` adds may be there already, and stays if it is to ``keep``.
    """
    df = df if set(SHARED) <= set(df.columns) else prepared(df, text)
    made = {name: f() for name, f in EXTRACTORS.items()}
    pick = lambda i: F.when(F.col(profile) == "governance", made["governance"][i]).when(F.col(profile) == "shareholder_return", made["shareholder_return"][i]).otherwise(made["financials"][i])
    df = df.withColumns({name: pick(i) for i, name in enumerate(names)}).drop(*(() if keep else SHARED))
    return df.withColumns({name: once(F.col(name)) for name, once in zip(names, (distinct_entities, distinct_relations), strict=True)})


def degraded(df: DataFrame) -> DataFrame:
    """The first half of entities (one at least) and relations; relations lose their schema and confidence."""
    weak = lambda r: F.struct(r["source_name"].alias("source_name"), F.concat(F.lit("unconstrained_"), r["relation_type"]).alias("relation_type"), r["target_name"].alias("target_name"), F.lit(0.45).alias("confidence"))
    half = lambda name: F.floor(F.size(name) / 2).cast("int")
    return df.withColumns({"entities": F.slice("entities", 1, F.greatest(F.lit(1), half("entities"))), "relations": F.transform(F.slice("relations", 1, half("relations")), weak)})


def induced_gold(df: DataFrame, question: str, answer: str, profile: str) -> DataFrame:
    """Adds gold_entities and gold_relations: proxy gold from question and answer by the target profile.

    All names are in normal form.
    """
    df = prepared(df.withColumn("_qa", F.concat(F.col(question), F.lit("\n"), F.col(answer))), "_qa")
    low, n, of = F.col("_low"), X.normalize, F.col(profile)
    has = lambda k: F.contains(low, F.lit(k))
    e = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("entity_type"))
    r = lambda a, kind, b: F.struct(a.alias("source_name"), F.lit(kind).alias("relation_type"), b.alias("target_name"))
    et, rt = "array<struct<name: string, entity_type: string>>", "array<struct<source_name: string, relation_type: string, target_name: string>>"
    people, audit = F.col("_people"), F.lit("audit committee")
    periods = F.col("_periods")
    metric = F.coalesce(*(F.when(has(m), F.lit(m)) for m in dims.METRICS))
    bought, dividend = has("repurchase") | has("buyback"), has("dividend")
    shares = F.when(has("common stock"), "common stock").when(has("common share"), "common share")
    program, firm = F.lit("share repurchase program"), F.lit("company")
    gov = _concat([F.transform(people, lambda p: e(n(p), "Person")), _if(has("audit committee"), e(audit, "Committee")), _if(has("chief executive officer"), e(F.lit("chief executive officer"), "OfficerRole"))], et)
    fin = _concat([F.transform("_amounts", lambda a: e(n(a), "MonetaryAmount")), F.transform(periods, lambda p: e(n(p), "ReportingPeriod")), _if(metric.isNotNull(), e(metric, "FinancialMetric"))], et)
    shr = _concat([_if(bought, e(program, "RepurchaseProgram")), _if(dividend, e(F.lit("dividend"), "Dividend")), _if(shares.isNotNull(), e(shares, "ShareClass"))], et)
    gov_r = _concat([F.when(has("audit committee"), F.transform(people, lambda p: r(n(p), "serves_on_committee", audit)))], rt)
    fin_r = _concat([_if(metric.isNotNull() & (F.size(periods) > 0), r(metric, "reported_for_period", n(F.get(periods, F.lit(0)))))], rt)
    shr_r = _concat([_if(bought, r(firm, "announced_repurchase", program)), _if(dividend, r(firm, "declared_dividend", F.lit("dividend")))], rt)
    none_e, none_r = F.array().cast(et), F.array().cast(rt)
    by = lambda g, f, s, other: F.array_distinct(F.when(of == "governance", g).when(of == "financials", f).when(of == "shareholder_return", s).otherwise(other))
    return df.withColumns({"gold_entities": by(gov, fin, shr, none_e), "gold_relations": by(gov_r, fin_r, shr_r, none_r)}).drop("_qa", *SHARED)


def from_model(response: Column) -> tuple[Column, Column]:
    """(entities, relations) of a model's JSON answer; null where it can't be read, items without a name left out."""
    parsed = X.lenient_json(response, MODEL_ANSWER)
    none_e, none_r = F.array().cast(ENTITIES), F.array().cast(RELATIONS)
    entities = F.transform(F.filter(parsed["entities"], lambda e: e["name"].isNotNull()), lambda e: entity(e["name"], e["entity_type"], 0.8))
    whole = F.filter(parsed["relations"], lambda r: r["source_name"].isNotNull() & r["target_name"].isNotNull())
    relations = F.transform(whole, lambda r: F.struct(r["source_name"].alias("source_name"), r["relation_type"].alias("relation_type"), r["target_name"].alias("target_name"), F.lit(0.78).alias("confidence")))
    known = F.coalesce(parsed["entities"].isNotNull() | parsed["relations"].isNotNull(), F.lit(False))
    return F.when(known, F.coalesce(entities, none_e)), F.when(known, F.coalesce(relations, none_r))


def mentions(df: DataFrame, keys: Sequence[str], column: str = "entities") -> DataFrame:
    """Rows of an array of mentions with their place ``pos``."""
    return df.select(*keys, F.posexplode(column).alias("pos", "_m")).select(*keys, "pos", "_m.*")

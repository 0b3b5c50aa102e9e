"""Driver queries on text functions, extraction, support and answers, each with its DuckDB twin.

Where the twin can't match text, the text is made of the tables' columns, so that what must be found follows from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.catalog import _FLAWED, _SENTENCES, _STAR, _flawed, _sql_tokens, _star, _star_mentions, _t
from factloom.catalog_runs import _pick, _sql_pick, sql_round
from factloom.functions import text as X
from factloom.operators import answers, evidence, extract, graph, profiles, quality, support, tables
from factloom.plans import dims
from factloom.registry import query
from factloom.sources import sinks
from factloom.sources.staging import folder

_W = r"[\t-\r\x1c-\x20\x85\p{Z}]"

# Text functions -----------------------------------------------------------------------------------


@query(
    rf"SELECT doc_id, CASE WHEN h = '' OR ends_with(h, '.') THEN h ELSE h || '.' END AS first_sentence FROM (SELECT doc_id, regexp_replace(CASE WHEN regexp_matches(text, '[\p{{L}}\p{{N}}_]\.{_W}+[A-Z]') "
    rf"THEN regexp_extract(text, '(?s)^(.*?[\p{{L}}\p{{N}}_])\.{_W}+[A-Z]', 1) ELSE text END, '^{_W}+|{_W}+$', '', 'g') AS h FROM documents)"
)
def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("first_sentence"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with periods, a firm and money, some of them lacking."""
    key = F.col("o_orderkey")
    firm = F.when(key % 3 == 0, F.lit("It")).otherwise(F.concat(F.lit("In May Acme  Trade "), _pick(["Inc.", "Corporation", "Holdings"], F.floor(key / 3)), F.lit(" it")))
    text = F.concat(firm, F.lit(" earned $"), key % 90 + 10, F.lit(" million in Q"), key % 4 + 1, F.lit(" 20"), key % 50 + 10, F.lit(" and usd "), key % 90 + 10, F.lit("  MILLION in FY20"), key % 50 + 10, F.lit(", 20"), key % 50 + 10, F.lit(".\n\n\n\nThe end of it"))
    return _t(spark, sf_dir, "orders").select(key.alias("id"), text.alias("text"))


_DATED = (
    f"d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'It' ELSE 'In May Acme  Trade ' || {_sql_pick(['Inc.', 'Corporation', 'Holdings'], '(o_orderkey // 3)')} || ' it' END || ' earned $' || (o_orderkey % 90 + 10) || ' million in Q' || (o_orderkey % 4 + 1) || ' 20' || (o_orderkey % 50 + 10) "
    "|| ' and usd ' || (o_orderkey % 90 + 10) || '  MILLION in FY20' || (o_orderkey % 50 + 10) || ', 20' || (o_orderkey % 50 + 10) || '.' || chr(10) || chr(10) || chr(10) || chr(10) || 'The end of it' AS text FROM orders)"
)


@query(
    f"SELECT o_orderkey AS id, 'FY20' || (o_orderkey % 50 + 10) || '|Q' || (o_orderkey % 4 + 1) || ' 20' || (o_orderkey % 50 + 10) AS longer, '20' || (o_orderkey % 50 + 10) AS year, "
    f"CASE WHEN o_orderkey % 3 <> 0 THEN 'In May Acme Trade ' || {_sql_pick(['Inc.', 'Corporation', 'Holdings'], '(o_orderkey // 3)')} END AS company, cast(4 AS INTEGER) AS n_amounts FROM orders"
)
def period_and_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods sorted without repeats, the firm with single blanks, and amounts that differ: money in dollars, the year, money in words, the year after FY is no other."""
    df = _dated(spark, sf_dir).select("id", X.periods(F.col("text")).alias("p"), X.company(F.col("text")).alias("company"), X.amounts(F.col("text")).alias("a"))
    return df.select("id", F.array_join(F.slice("p", 2, 9), "|").alias("longer"), F.get("p", F.lit(0)).alias("year"), "company", (F.size("a") + 1).alias("n_amounts"))


@query(
    f"WITH {_DATED}, s AS (SELECT id, regexp_replace(text, chr(10) || chr(10) || chr(10) || '+', chr(10) || chr(10), 'g') AS t FROM d) "
    "SELECT id, CASE WHEN length(t) <= 90 THEN t ELSE regexp_replace(rtrim(substr(t, 1, 90)), ' [^ ]*$', '') || chr(10) || chr(10) || '[Truncated]' || chr(10) || 'Context truncated to the shared answer-context budget.' END AS cut FROM s"
)
def context_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("id", X.truncated(F.col("text"), 90).alias("cut"))


@query(
    "WITH n AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, (o_orderkey % 300) / 1::DOUBLE AS v FROM orders) SELECT id, CASE k WHEN 0 THEN 0.85 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 WHEN 5 THEN 0.4 "
    f"ELSE {sql_round('least(CASE WHEN v > 1 AND v <= 100 THEN v / 100 ELSE v END, 1.0::DOUBLE)')} END::DOUBLE AS confidence, CASE k WHEN 0 THEN cast(id AS INTEGER) WHEN 1 THEN cast(id AS INTEGER) END AS parsed, "
    f"{_sql_pick(['holds the role', 'reports', 'made up link'], 'id')} AS phrase FROM n"
)
def lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences in words, numbers and percent; JSON whole or inside noise; relations as phrases."""
    key = F.col("o_orderkey")
    said = F.element_at(F.array(F.lit(" Very HIGH"), F.lit("moderate"), F.lit("low "), (key % 300).cast("string"), F.concat(F.lit("about "), key % 300, F.lit(" percent")), F.lit("none")), (key % 6).cast("int") + 1)
    json = F.when(key % 6 == 0, F.concat(F.lit('{"a": '), key, F.lit("}"))).when(key % 6 == 1, F.concat(F.lit('so {"a": '), key, F.lit("} it is"))).otherwise("no json")
    phrase = X.relation_phrase(_pick(["holds_role", "reports_metric", "made_up_link"], key), dims.RELATION_PHRASES)
    return _t(spark, sf_dir, "orders").select(key.alias("id"), X.confidence(said).alias("confidence"), X.lenient_json(json, "a int")["a"].alias("parsed"), phrase.alias("phrase"))


@query("SELECT doc_id, doc_id % 4 = 2 AS plain FROM documents WHERE doc_id % 4 <> 3")
def category_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loader's filter collapses blanks, the ingest's does not."""
    names = ["financials", "governance", "shareholder return"]
    df = _t(spark, sf_dir, "documents").select("doc_id", _pick([" governance", "Shareholder  RETURN", "FINANCIALS", "other"], F.col("doc_id")).alias("category"))
    plain = tables.category_filter(df, "category", names, collapse=False).select("doc_id", F.lit(True).alias("plain"))
    return tables.category_filter(df, "category", names).join(plain, "doc_id", "left").select("doc_id", F.coalesce("plain", F.lit(False)).alias("plain"))


@query(
    "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'governance' WHEN c_custkey % 3 = 1 THEN 'shareholder_return' ELSE 'financials' END AS selected_profile, CASE WHEN c_custkey % 3 = 2 THEN 0.55 ELSE 0.9 END::DOUBLE AS confidence, "
    "CASE WHEN c_custkey % 3 = 2 THEN 'soft' ELSE 'strict' END AS mapping_policy, cast(CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 2 END AS INTEGER) AS n_candidates FROM customer"
)
def profile_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), _pick([" Governance", "shareholder RETURN", "Liquidity"], F.col("c_custkey")).alias("section_type"))
    return profiles.by_section(df, dims.SECTION_PROFILES).select("doc_id", "selected_profile", "confidence", "mapping_policy", F.size("candidate_profiles").alias("n_candidates"))


# Extraction ---------------------------------------------------------------------------------------


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short text of each profile for every customer; two bits of the key add sentences."""
    key = F.col("c_custkey")
    b0, b1 = key.bitwiseAND(F.lit(1)) == 1, key.bitwiseAND(F.lit(2)) == 2
    more = lambda bit, text: F.when(bit, F.lit(text)).otherwise("")
    gov = F.concat(F.lit("Acme Company."), more(b0, " Ann Lee is Chief Executive Officer."), more(b1, " Bob Ray sits on the audit committee, ann lee too."))
    fin = F.concat(F.lit("Acme Company reported revenue of $"), key % 90 + 10, F.lit(" million in Q1 2024."), more(b0, " The consumer segment made 7."))
    shr = F.concat(F.lit("Acme Company paid a dividend."), more(b0, " It continued its share repurchase of $9 million."), more(b1, " Each common share counts."))
    profile = _pick(list(dims.PROFILES), F.floor(key / 4))
    return _t(spark, sf_dir, "customer").select(key.alias("id"), profile.alias("selected_profile"), F.when(profile == "governance", gov).when(profile == "financials", fin).otherwise(shr).alias("source_text"))


_STORIES = (
    f"x AS (SELECT c_custkey AS id, {_sql_pick(list(dims.PROFILES), '(c_custkey // 4)')} AS profile, c_custkey & 1 AS b0, (c_custkey & 2) // 2 AS b1 FROM customer), "
    "n AS (SELECT *, CASE profile WHEN 'governance' THEN 2 + 3 * b0 + 2 * b1 WHEN 'financials' THEN 6 + 2 * b0 ELSE 2 + 2 * b0 + b1 END AS e, "
    "CASE profile WHEN 'governance' THEN b0 + b1 * (2 + b0) WHEN 'financials' THEN 2 + b0 ELSE 1 + b0 + b1 END AS r FROM x)"
)


@query(
    f"WITH {_STORIES} SELECT id, cast(e AS INTEGER) AS n_entities, cast(r AS INTEGER) AS n_relations, CASE WHEN r > 0 THEN CASE profile WHEN 'governance' THEN CASE WHEN b0 = 1 THEN 'Acme Company holds_role Chief Executive Officer' ELSE 'Acme Company serves_on_committee Audit Committee' END "
    "WHEN 'financials' THEN 'Acme Company reports_metric Revenue' ELSE CASE WHEN b0 = 1 THEN 'Acme Company announced_repurchase Share Repurchase Program' ELSE 'Acme Company declared_dividend Dividend' END END END AS first_relation FROM n"
)
def extraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and relations by the heuristics of each profile."""
    found = extract.extract(_stories(spark, sf_dir))
    first = F.get("relations", F.lit(0))
    return found.select("id", F.size("entities").alias("n_entities"), F.size("relations").alias("n_relations"), F.when(first.isNotNull(), F.concat_ws(" ", first["source_name"], first["relation_type"], first["target_name"])).alias("first_relation"))


@query(f"WITH {_STORIES} SELECT id, cast(greatest(1, e // 2) AS INTEGER) AS n_entities, cast(r // 2 AS INTEGER) AS n_relations, CASE WHEN r >= 2 THEN 0.45::DOUBLE END AS confidence FROM n")
def extraction_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.degraded(extract.extract(_stories(spark, sf_dir)))
    weak = F.filter("relations", lambda r: F.startswith(r["relation_type"], F.lit("unconstrained_")))
    return found.select("id", F.size("entities").alias("n_entities"), F.size(weak).alias("n_relations"), F.get(weak, F.lit(0))["confidence"].alias("confidence"))


# Graph, support, answers --------------------------------------------------------------------------


@query(f"WITH {_STAR} SELECT node_id, 'x' AS kind, alias FROM (SELECT DISTINCT node_id, name AS alias FROM ev)")
def node_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.node_sets(*_star_mentions(spark, sf_dir))[0]
    return found.select("node_id", F.lit("x").alias("kind"), "alias")


@query(f"WITH {_FLAWED} SELECT edge_id FROM whole WHERE (profile, relation_type) IN (('geo', 'in_region'), ('stock', 'supplies_from'))")
def edges_without_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, allowed = _flawed(spark, sf_dir)
    return quality.without_issues(edges, quality.analyze(nodes, edges, allowed)).select("edge_id")


@query(
    f"WITH {_FLAWED} SELECT 'node' AS kind, node_id AS id, CASE WHEN node_id NOT IN (SELECT source_node_id FROM whole UNION SELECT target_node_id FROM whole) THEN 'disconnected_node' END AS issues, NULL::VARCHAR AS questions FROM fn "
    "UNION ALL SELECT 'edge', edge_id, CASE WHEN edge_id NOT IN (SELECT edge_id FROM whole) THEN 'dangling_edge' WHEN (profile, relation_type) NOT IN (('geo', 'in_region'), ('stock', 'supplies_from')) THEN 'schema_violation' END, "
    "CASE WHEN relation_type = 'in_region' THEN 'q1,q2' END FROM g"
)
def annotated_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges with the issues that name them and the questions that edges support."""
    nodes, edges, allowed = _flawed(spark, sf_dir)
    used = edges.where("relation_type = 'in_region'").select("graph_id", "edge_id", F.explode(F.array(F.lit("q2"), F.lit("q1"))).alias("question_id"))
    n, e = quality.annotated(nodes, edges, quality.analyze(nodes, edges, allowed), used)
    both = n.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.array_join("quality_issues", ",").alias("issues"), F.lit(None).cast("string").alias("questions"))
    return both.unionByName(e.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), F.array_join("quality_issues", ",").alias("issues"), F.array_join("query_support", ",").alias("questions")))


@query(f"WITH {_FLAWED} SELECT edge_id FROM whole")
def graph_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice and read back: edges without an end are not stored, later rows replace earlier ones."""
    nodes, edges, _ = _flawed(spark, sf_dir)
    root = folder(spark, "graph")
    sinks.write_graph(nodes, edges.where("profile <> 'stock'"), root, 1)
    sinks.write_graph(nodes, edges, root, 2)
    return sinks.read_graph(spark, root)[1].select("edge_id")


@query("SELECT r_name AS question_id, 2 / 3::DOUBLE AS support_score, false AS answerable, cast(25 AS BIGINT) AS n_edges, lower(r_name) AS filled, 'nowhere' AS missing FROM region")
def support_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots filled by a question's own hints: its region is in the graph, the other slot is nowhere."""
    nodes, edges = _star(spark, sf_dir)
    name = F.lower("r_name")
    questions = _t(spark, sf_dir, "region").select(
        F.lit("star").alias("graph_id"), F.col("r_name").alias("question_id"), F.lit("geo").alias("target_profile"), F.lit("none").alias("intent_id"), F.array(F.lit("in_region")).alias("required_relations"),
        F.array().cast("array<string>").alias("required_entity_types"), F.array(name, F.lit("nowhere")).alias("focus_slots"), F.create_map(name, F.array(name), F.lit("nowhere"), F.array(F.lit("atlantis"))).alias("focus_slot_hints"),
    )
    found = support.analyze(questions, edges, nodes, dims.SLOT_HINTS)
    return found.select("question_id", "support_score", "answerable", "n_edges", F.array_join("filled_slots", ",").alias("filled"), F.array_join(support.missing_slots(F.col("missing_requirements")), ",").alias("missing"))


def _worded(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"WITH s AS (SELECT doc_id, lang, unnest({_SENTENCES.format(c='text')}) AS s, generate_subscripts({_SENTENCES.format(c='text')}, 1) - 1 AS pos FROM documents), w AS (SELECT *, {_worded('s')} AS n FROM s), "
    "o AS (SELECT doc_id, pos, contains(n, 'the')::INT + contains(n, lang)::INT AS endpoint_overlap, contains(n, 'of')::INT + contains(n, 'and')::INT AS relation_overlap, length(s) AS len FROM w) "
    "SELECT doc_id, cast(pos AS INTEGER) AS pos, cast(endpoint_overlap AS INTEGER) AS endpoint_overlap, cast(relation_overlap AS INTEGER) AS relation_overlap FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY endpoint_overlap DESC, relation_overlap DESC, len DESC, pos) <= 2"
)
def provenance_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sentences of every document for one edge a document."""
    docs = _t(spark, sf_dir, "documents")
    edges = docs.select("doc_id", F.lit("e").alias("edge_id"), F.lit("The").alias("source_name"), F.lit("of_and").alias("relation_type"), F.col("lang").alias("target_name"))
    lines = evidence.sentence_rows(docs.select("doc_id", F.array("text").alias("references")), ["doc_id"])
    return evidence.snippets(edges, lines, "doc_id", 2).select("doc_id", "pos", "endpoint_overlap", "relation_overlap")


@query(
    f"WITH p AS (SELECT d.doc_id, d.text, d.lang, b.text AS question FROM (SELECT doc_id, text, lang, doc_id % n AS item_id FROM documents, (SELECT count(*) AS n FROM benchmark)) d JOIN benchmark b ON d.item_id = b.item_id), "
    f"s AS (SELECT doc_id, lang, question, unnest({_SENTENCES.format(c='text')}) AS s, generate_subscripts({_SENTENCES.format(c='text')}, 1) - 1 AS pos FROM p), w AS (SELECT *, {_worded('s')} AS n FROM s), "
    f"o AS (SELECT doc_id, pos, contains(n, 'the')::INT + contains(n, lang)::INT AS eo, len(list_intersect(list_distinct({_sql_tokens('s')}), list_distinct({_sql_tokens('question')}))) AS tk, length(s) AS len FROM w) "
    "SELECT doc_id, cast(pos AS INTEGER) AS pos, cast(eo AS INTEGER) AS edge_overlap, cast(tk AS INTEGER) AS token_overlap FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY eo DESC, tk DESC, len DESC, pos) <= 3"
)
def sentences_by_edge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference sentences ranked by terms of edges first."""
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("question"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    df = docs.withColumn("item_id", F.col("doc_id") % F.lit(items.count())).join(items, "item_id").withColumns({"references": F.array("text"), "terms": F.array(F.lit("the"), F.col("lang"), F.lit("the"), F.lit(""))})
    return evidence.reference_sentences(df, ["doc_id"], "question", terms="terms", limit=3).select("doc_id", "pos", "edge_overlap", "token_overlap")


@query(
    "SELECT n_name AS id, 'Graph-grounded evidence indicates: ' || n_name || ' in region ' || r_name || '; ' || n_name || ' reports Cash. Supporting reference text: ' || n_name || ' lies there. Yes.' || '.' "
    "|| CASE WHEN n_nationkey % 2 = 1 THEN ' Missing graph support for: slot.' ELSE '' END AS answer FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0 "
    "UNION ALL SELECT n_name, CASE WHEN n_nationkey % 2 = 1 THEN 'Graph evidence does not ground the required slots for this question. Missing slots: slot.' ELSE 'Graph evidence does not provide grounded triples for this question.' END FROM nation WHERE n_nationkey % 5 = 0"
)
def bundle_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of a nation's two edges and the answers made of them; every fifth nation has no edges."""
    both = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def edge(nth: int, kind: str, target: Column, confidence: float) -> DataFrame:
        return both.where("n_nationkey % 5 <> 0").select(
            F.col("n_name").alias("id"), F.lit(f"e{nth}").alias("edge_id"), F.lit(nth).alias("ord"), F.col("n_name").alias("source_name"), F.lit("Nation").alias("source_type"), F.lit(kind).alias("relation_type"),
            target.alias("target_name"), F.lit("T").alias("target_type"), F.lit(confidence).alias("confidence"),
        )

    used = edge(0, "reports_metric", F.lit("Cash"), 0.5).unionByName(edge(1, "in_region", F.col("r_name"), 0.9)).unionByName(edge(2, "chairs", F.lit(None).cast("string"), 0.95))
    quotes = both.select(F.col("n_name").alias("id"), F.lit("e1").alias("edge_id"), F.explode(F.array(F.concat("n_name", F.lit(" lies there.")), F.lit("Yes."), F.lit("No."))).alias("sentence"))
    rows = quotes.withColumn("pos", F.when(F.col("sentence") == "Yes.", 1).when(F.col("sentence") == "No.", 2).otherwise(0))
    bundles = evidence.bundle(used, rows, ["id"])
    asked = both.select(F.col("n_name").alias("id"), F.when(F.col("n_nationkey") % 2 == 1, F.array(F.lit("slot"))).otherwise(F.array().cast("array<string>")).alias("missing"))
    return asked.join(bundles, "id", "left").select("id", answers.from_bundle(F.col("triples"), F.col("missing")).alias("answer"))


@query(f"SELECT o_orderkey AS id, {sql_round('least((0.55::DOUBLE + least(o_orderkey % 5, 3) * 0.1::DOUBLE) * greatest(0.25::DOUBLE, (o_custkey % 9) / 8::DOUBLE), 0.92::DOUBLE)')} AS confidence FROM orders")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), answers.graph_confidence(F.col("o_orderkey") % 5, (F.col("o_custkey") % 9) / 8.0).alias("confidence"))


@query(
    "SELECT cast(doc_id AS VARCHAR) AS id, (['Insufficient grounded context to answer from the question alone.', 'One. Two.', CASE WHEN doc_id % 2 = 0 THEN 'Graph-grounded evidence: A holds role B.' ELSE 'Graph evidence is incomplete. Missing slots: s.' END])[cast(doc_id % 3 AS INTEGER) + 1] AS answer, "
    "([0.12, 0.35, CASE WHEN doc_id % 2 = 0 THEN 0.42 ELSE 0.18 END])[cast(doc_id % 3 AS INTEGER) + 1]::DOUBLE AS confidence FROM documents"
)
def shared_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answerer that all contexts share, without a model."""
    triple = F.struct(F.lit("A").alias("source_name"), F.lit("holds_role").alias("relation_type"), F.lit("B").alias("target_name"))
    key = F.col("doc_id")
    triples = F.when(key % 2 == 0, F.array(triple))
    text, sure = answers.shared(_pick(["question_only", "reference_only", "graph_evidence_bundle"], key), F.array(F.lit(" One. "), F.lit(" "), F.lit("Two."), F.lit("Three.")), triples, F.array(F.lit("s")))
    return _t(spark, sf_dir, "documents").select(key.cast("string").alias("id"), text.alias("answer"), sure.alias("confidence"))

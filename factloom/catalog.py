"""Driver queries: every operator family applied to the driver's tables, with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import evidence, extract, graph, metrics, profiles, quality, support, tables
from factloom.registry import query

#: Keyword profiles of the tables' languages, and intents of chat roles: small dimensions like the ontology's.
LANGUAGES = {
    "en": (" the ", " of ", " and ", " to ", " is "),
    "fr": (" les ", " des ", " pour ", " est ", " une "),
    "de": (" der ", " die ", " und ", " mit ", " nicht "),
    "es": (" del ", " los ", " por ", " con ", " una "),
}
INTENTS = {
    "user": {"ask_time": (("when", "and the", "was"),), "ask_place": (("where", "from", "in the"),), "ask_thing": (("what", "that", "of the"),)},
    "assistant": {"explain": (("because", "the", "for"),), "list": (("and", "or", "with"),)},
    "system": {"instruct": (("must", "the", "be"),), "role": (("you", "are", "is"),)},
}
DEFAULTS = {"user": "ask_thing", "assistant": "explain", "system": "instruct"}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_tokens(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _sql_score(c: str, words: tuple[str, ...]) -> str:
    return " + ".join(f"cast(contains({c}, '{w}') AS INTEGER)" for w in words)


# Text -------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, cast(len(t) AS BIGINT) AS n_tokens, cast(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_sql_tokens('text')} AS t FROM documents)")
def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return df.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_sql_tokens('text')}) AS token FROM documents) GROUP BY token")
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _t(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


WHITE = r"[\t-\r\x1c-\x20\x85\p{{Z}}]"
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({{c}}, '([.!?]){WHITE}+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^{WHITE}+|{WHITE}+$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, cast(len({_SENTENCES.format(c='text')}) AS BIGINT) AS n_sentences FROM documents")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(
    r"SELECT doc_id, cast(len(regexp_extract_all(m, '\b([A-Z][a-z]+(?: [A-Z]\.)? [A-Z][a-z]+)\b', 1)) AS BIGINT) AS n_persons, "
    r"cast(len(list_distinct(list_transform(regexp_extract_all(m, '\b([A-Z][a-z]+(?: [A-Z]\.)? [A-Z][a-z]+)\b', 1), lambda p: lower(p)))) AS BIGINT) AS n_names "
    r"FROM (SELECT doc_id, regexp_replace(text, '[^\P{L}A-Za-z]', '_', 'g') AS m FROM documents)"
)
def extract_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "documents").select("doc_id", X.persons(F.col("text")).alias("p"))
    return df.select("doc_id", F.size("p").cast("long").alias("n_persons"), F.size(X.first_of_each(F.col("p"))).cast("long").alias("n_names"))


@query(
    r"SELECT doc_id, cast(len(a) AS BIGINT) AS n_amounts, cast(len(list_distinct(a)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, list_filter(list_transform(list_transform("
    r"regexp_extract_all(text, '(?i)(?:USD\s*)?\$?\s?\d+(?:\.\d+)?\s?(?:billion|million|thousand|%)?'), lambda a: trim(regexp_replace(a, '\s+', ' ', 'g'))), lambda a: lower(a)), lambda a: length(a) >= 2) AS a FROM documents)"
)
def extract_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(F.transform(F.regexp_extract_all(F.col("text"), F.lit(X.LOOSE_MONEY), 0), X.collapsed), lambda a: F.length(a) >= 2)
    df = _t(spark, sf_dir, "documents").select("doc_id", found.alias("a"), X.amounts(F.col("text")).alias("d"))
    return df.select("doc_id", F.size("a").cast("long").alias("n_amounts"), F.size("d").cast("long").alias("n_distinct"))


# Profiles and intents -----------------------------------------------------------------------------

_PROFILE_SQL = (
    "SELECT doc_id, lang, CASE WHEN m > 0 THEN name ELSE 'none' END AS selected_profile, m AS profile_score FROM (SELECT doc_id, lang, s, greatest(s.en, s.fr, s.de, s.es) AS m, "
    "CASE greatest(s.en, s.fr, s.de, s.es) WHEN s.en THEN 'en' WHEN s.fr THEN 'fr' WHEN s.de THEN 'de' ELSE 'es' END AS name FROM (SELECT doc_id, lang, struct_pack("
    + ", ".join(f"{name} := {_sql_score('lower(text)', words)}" for name, words in LANGUAGES.items())
    + ") AS s FROM documents))"
)


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return profiles.by_keywords(docs, F.col("text"), LANGUAGES, F.lit("none"))


@query(f"SELECT doc_id, selected_profile, profile_score FROM ({_PROFILE_SQL})")
def profile_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(spark, sf_dir).select("doc_id", "selected_profile", "profile_score")


@query(f"SELECT lang, avg(CASE WHEN selected_profile = lang THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy, count(*) AS n FROM ({_PROFILE_SQL}) GROUP BY lang")
def profile_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(_profiled(spark, sf_dir).withColumn("gold", F.col("lang")), "selected_profile", "gold", "lang")


@query(f"SELECT lang, selected_profile, count(*) AS n FROM ({_PROFILE_SQL}) GROUP BY ALL")
def profile_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(spark, sf_dir).groupBy("lang", "selected_profile").agg(F.count(F.lit(1)).alias("n"))


def _intent_sql() -> str:
    cases = []
    for role, specs in INTENTS.items():
        scores = {name: _sql_score("t", spec[0]) for name, spec in specs.items()}
        top = f"greatest({', '.join(scores.values())})"
        ranked = " ".join(f"WHEN {s} = {top} THEN '{name}'" for name, s in scores.items())
        cases.append(f"WHEN role = '{role}' THEN CASE WHEN {top} = 0 THEN '{DEFAULTS[role]}' {ranked} END")
    return f"SELECT conv_id, turn, CASE {' '.join(cases)} END AS intent_id FROM (SELECT *, lower(text) AS t FROM conversations)"


@query(_intent_sql())
def intent_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", profiles.intent(F.col("role"), F.col("text"), INTENTS, DEFAULTS).alias("intent_id"))


# Graph --------------------------------------------------------------------------------------------


def _star_mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The star schema as mentions: nations, regions, customers, suppliers, parts; parts are in no relation."""
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    customer, supplier, part = (_t(spark, sf_dir, t) for t in ("customer", "supplier", "part"))
    base = [F.lit("star").alias("graph_id")]

    def typed(df: DataFrame, ord_: int, profile: str, key: str, name: str, kind: str) -> DataFrame:
        return df.select(*base, F.lit(ord_).alias("doc_ord"), F.lit(profile).alias("doc_id"), F.lit(profile).alias("profile"), F.col(key).cast("int").alias("pos"), F.col(name).alias("name"), F.lit(kind).alias("entity_type"), F.lit(0.9).alias("confidence"))

    entities = typed(region, 0, "geo", "r_regionkey", "r_name", "Region").unionByName(typed(nation, 1, "geo", "n_nationkey", "n_name", "Nation"))
    entities = entities.unionByName(typed(customer.where("c_acctbal >= 0"), 2, "sales", "c_custkey", "c_name", "Customer")).unionByName(typed(part, 3, "stock", "p_partkey", "p_name", "Part"))

    def related(df: DataFrame, ord_: int, profile: str, key: str, source: str, kind: str) -> DataFrame:
        return df.select(*base, F.lit(ord_).alias("doc_ord"), F.lit(profile).alias("doc_id"), F.lit(profile).alias("profile"), F.col(key).cast("int").alias("pos"), F.col(source).alias("source_name"), F.lit(kind).alias("relation_type"), F.col("_to").alias("target_name"), F.lit(0.8).alias("confidence"))

    in_region = nation.join(region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("_to")), "n_regionkey")
    place = nation.select("n_nationkey", F.col("n_name").alias("_to"))
    of_customer = customer.join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    of_supplier = supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    relations = related(in_region, 1, "geo", "n_nationkey", "n_name", "in_region").unionByName(related(of_customer, 2, "sales", "c_custkey", "c_name", "lives_in"))
    return entities, relations.unionByName(related(of_supplier, 4, "stock", "s_suppkey", "s_name", "supplies_from"))


def _star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.build(*_star_mentions(spark, sf_dir))


_SLUG = "regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_STAR = f"""
e AS (
  SELECT 0 AS o, 0 AS ph, r_regionkey AS pos, r_name AS name, 'Region' AS kind, 'geo' AS profile FROM region
  UNION ALL SELECT 1, 0, n_nationkey, n_name, 'Nation', 'geo' FROM nation
  UNION ALL SELECT 2, 0, c_custkey, c_name, 'Customer', 'sales' FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT 3, 0, p_partkey, p_name, 'Part', 'stock' FROM part
), r AS (
  SELECT 1 AS o, n_nationkey AS pos, n_name AS s, 'in_region' AS rel, r_name AS t, 'geo' AS profile FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 2, c_custkey, c_name, 'lives_in', n_name, 'sales' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 4, s_suppkey, s_name, 'supplies_from', n_name, 'stock' FROM supplier JOIN nation ON s_nationkey = n_nationkey
), ev AS (
  SELECT {_SLUG.format(c="name")} AS node_id, name, kind, profile, (o, 0, pos, 0) AS k FROM e
  UNION ALL SELECT {_SLUG.format(c="s")}, s, 'UnresolvedEntity', profile, (o, 1, pos, 0) FROM r
  UNION ALL SELECT {_SLUG.format(c="t")}, t, 'UnresolvedEntity', profile, (o, 1, pos, 1) FROM r
), n AS (
  SELECT node_id, arg_min(name, k) AS name, arg_min(kind, k) AS entity_type, arg_min(profile, k) AS profile, count(DISTINCT name) AS n_aliases, list(DISTINCT lower(name)) AS aliases FROM ev GROUP BY node_id
), g AS (
  SELECT profile || ':' || profile || ':' || (pos + 1) || ':' || {_SLUG.format(c="s")} || ':' || rel || ':' || {_SLUG.format(c="t")} AS edge_id,
    {_SLUG.format(c="s")} AS source_node_id, rel AS relation_type, {_SLUG.format(c="t")} AS target_node_id, profile FROM r
)"""


@query(f"WITH {_STAR} SELECT node_id, name, entity_type, profile, n_aliases FROM n")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _star(spark, sf_dir)
    return nodes.select("node_id", "name", "entity_type", "profile", F.size("aliases").cast("long").alias("n_aliases"))


@query(f"WITH {_STAR} SELECT edge_id, source_node_id, relation_type, target_node_id, profile FROM g")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _star(spark, sf_dir)[1].select("edge_id", "source_node_id", "relation_type", "target_node_id", "profile")


def _flawed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The star graph without its unresolved suppliers: their edges dangle; the ontology lacks ``lives_in``."""
    nodes, edges = _star(spark, sf_dir)
    allowed = spark.createDataFrame([("geo", "in_region"), ("stock", "supplies_from")], "profile string, relation_type string")
    return nodes.where("NOT (entity_type = 'UnresolvedEntity' AND profile = 'stock')"), edges, allowed


_FLAWED = f"{_STAR}, fn AS (SELECT * FROM n WHERE NOT (entity_type = 'UnresolvedEntity' AND profile = 'stock')), whole AS (SELECT * FROM g WHERE source_node_id IN (SELECT node_id FROM fn) AND target_node_id IN (SELECT node_id FROM fn))"


@query(f"WITH {_FLAWED} SELECT edge_id FROM g WHERE source_node_id NOT IN (SELECT node_id FROM fn) OR target_node_id NOT IN (SELECT node_id FROM fn)")
def quality_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = _flawed(spark, sf_dir)
    return quality.dangling_edges(nodes, edges).select(F.col("object_id").alias("edge_id"))


@query(f"WITH {_FLAWED} SELECT edge_id FROM whole WHERE (profile, relation_type) NOT IN (('geo', 'in_region'), ('stock', 'supplies_from'))")
def quality_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.schema_violations(*_flawed(spark, sf_dir)).select(F.col("object_id").alias("edge_id"))


@query(f"WITH {_FLAWED} SELECT node_id FROM fn WHERE node_id NOT IN (SELECT source_node_id FROM whole UNION SELECT target_node_id FROM whole)")
def quality_disconnected(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = _flawed(spark, sf_dir)
    return quality.disconnected_nodes(nodes, edges).select(F.col("object_id").alias("node_id"))


@query(f"WITH {_FLAWED}, tagged AS (SELECT 'part_type' AS graph_id, p_partkey AS node_id, lower(p_brand) AS alias FROM part) SELECT alias, count(*) AS n FROM tagged GROUP BY alias HAVING count(*) > 1")
def quality_duplicate_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _t(spark, sf_dir, "part").select(F.lit("part_type").alias("graph_id"), F.col("p_partkey").alias("node_id"), F.array("p_brand").alias("aliases"))
    return quality.duplicate_aliases(nodes).select(F.col("object_id").alias("alias"), F.col("count").alias("n"))


@query(
    f"WITH {_FLAWED} SELECT * FROM (SELECT 'dangling_edge' AS issue_type, count(*) AS n_issues FROM g WHERE edge_id NOT IN (SELECT edge_id FROM whole) "
    "UNION ALL SELECT 'schema_violation', count(*) FROM whole WHERE (profile, relation_type) NOT IN (('geo', 'in_region'), ('stock', 'supplies_from')) "
    "UNION ALL SELECT 'disconnected_node', count(*) FROM fn WHERE node_id NOT IN (SELECT source_node_id FROM whole UNION SELECT target_node_id FROM whole) "
    "UNION ALL SELECT 'duplicate_alias', count(*) FROM (SELECT a FROM (SELECT DISTINCT node_id, name, lower(name) AS a FROM ev WHERE node_id IN (SELECT node_id FROM fn)) GROUP BY a HAVING count(*) > 1)) WHERE n_issues > 0"
)
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.counts(quality.analyze(*_flawed(spark, sf_dir)))


@query(
    "WITH q AS (SELECT n_name AS question_id, CASE n_nationkey % 3 WHEN 0 THEN 'geo' WHEN 1 THEN 'sales' ELSE 'stock' END AS profile, "
    "CASE n_nationkey % 3 WHEN 0 THEN ['in_region'] WHEN 1 THEN ['lives_in', 'in_region'] ELSE ['supplies_from'] END AS req, ['Nation', 'Customer'] AS types FROM nation), "
    f"{_STAR}, u AS (SELECT q.question_id, g.* FROM (SELECT *, unnest(req) AS rel FROM q) q JOIN g ON g.profile = q.profile AND g.relation_type = q.rel), "
    "m AS (SELECT question_id, list(DISTINCT relation_type) AS rels, count(DISTINCT edge_id) AS n_edges FROM u GROUP BY 1), "
    "mt AS (SELECT question_id, list(DISTINCT entity_type) AS types FROM (SELECT question_id, unnest([source_node_id, target_node_id]) AS node_id FROM u) JOIN n USING (node_id) GROUP BY 1) "
    "SELECT q.question_id, (len(list_intersect(req, coalesce(rels, []))) + len(list_intersect(q.types, coalesce(mt.types, [])))) / (len(req) + 2)::DOUBLE AS support_score, "
    "len(list_intersect(req, coalesce(rels, []))) + len(list_intersect(q.types, coalesce(mt.types, []))) = len(req) + 2 AS answerable, coalesce(n_edges, 0) AS n_edges FROM q LEFT JOIN m USING (question_id) LEFT JOIN mt USING (question_id)"
)
def query_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _star(spark, sf_dir)
    kind = F.col("n_nationkey") % 3
    names = lambda *x: F.array(*map(F.lit, x))
    questions = _t(spark, sf_dir, "nation").select(
        F.lit("star").alias("graph_id"),
        F.col("n_name").alias("question_id"),
        F.when(kind == 0, "geo").when(kind == 1, "sales").otherwise("stock").alias("target_profile"),
        F.lit("none").alias("intent_id"),
        F.when(kind == 0, names("in_region")).when(kind == 1, names("lives_in", "in_region")).otherwise(names("supplies_from")).alias("required_relations"),
        names("Nation", "Customer").alias("required_entity_types"),
        F.array().cast("array<string>").alias("focus_slots"),
    )
    found = support.analyze(questions, edges, nodes, {})
    return found.select("question_id", "support_score", "answerable", "n_edges")


# Evidence -----------------------------------------------------------------------------------------


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document beside the benchmark item its number falls to."""
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("question"))
    n = items.count()
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("item_id", F.col("doc_id") % F.lit(n)).join(items, "item_id")


_MATCHED = "SELECT d.doc_id, d.text, b.text AS question FROM (SELECT doc_id, text, doc_id % n AS item_id FROM documents, (SELECT count(*) AS n FROM benchmark)) d JOIN benchmark b ON d.item_id = b.item_id"


@query(
    f"SELECT doc_id, pos, token_overlap, length FROM (SELECT doc_id, cast(pos - 1 AS INTEGER) AS pos, cast(len(list_intersect(list_distinct({_sql_tokens('s')}), list_distinct({_sql_tokens('question')}))) AS INTEGER) AS token_overlap, cast(length(s) AS INTEGER) AS length "
    f"FROM (SELECT doc_id, question, unnest({_SENTENCES.format(c='text')}) AS s, generate_subscripts({_SENTENCES.format(c='text')}, 1) AS pos FROM ({_MATCHED}))) "
    "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY token_overlap DESC, length DESC, pos) <= 2"
)
def reference_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _matched(spark, sf_dir).withColumn("references", F.array("text"))
    return evidence.reference_sentences(df, ["doc_id"], "question").select("doc_id", "pos", "token_overlap", "length")


@query(
    f"WITH p AS ({_MATCHED}), l AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest({_sql_tokens('text')}) AS t FROM p) GROUP BY ALL), r AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest({_sql_tokens('question')}) AS t FROM p) GROUP BY ALL), "
    "o AS (SELECT l.doc_id, sum(least(l.c, r.c)) AS common FROM l JOIN r USING (doc_id, t) GROUP BY 1), nl AS (SELECT doc_id, sum(c) AS n FROM l GROUP BY 1), nr AS (SELECT doc_id, sum(c) AS n FROM r GROUP BY 1) "
    "SELECT p.doc_id, coalesce(2.0::DOUBLE * coalesce(common, 0)::DOUBLE / nullif(coalesce(nl.n, 0) + coalesce(nr.n, 0), 0)::DOUBLE, 0.0) AS token_f1 FROM p LEFT JOIN o USING (doc_id) LEFT JOIN nl USING (doc_id) LEFT JOIN nr USING (doc_id)"
)
def token_f1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.token_f1(_matched(spark, sf_dir), ["doc_id"], "text", "question")


@query(
    "WITH p AS (SELECT lang, doc_id FROM documents WHERE n_chars > 1000), g AS (SELECT lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1), "
    "b AS (SELECT coalesce(p.lang, g.lang) AS lang, p.doc_id IS NOT NULL AS ip, g.doc_id IS NOT NULL AS ig FROM p FULL JOIN g USING (lang, doc_id)), "
    "c AS (SELECT lang, count(*) FILTER (ip AND ig) AS tp, count(*) FILTER (ip) AS n_predicted, count(*) FILTER (ig) AS n_gold FROM b GROUP BY lang) "
    "SELECT lang, tp, n_predicted, n_gold, coalesce(tp / nullif(n_predicted, 0)::DOUBLE, 0.0) AS precision, coalesce(tp / nullif(n_gold, 0)::DOUBLE, 0.0) AS recall, 2.0::DOUBLE * tp / (n_predicted + n_gold) AS f1 FROM c"
)
def extraction_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    gold = docs.join(_t(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    return metrics.set_scores(docs.where("n_chars > 1000"), gold, ["doc_id"], ["lang"])


# Run tables ---------------------------------------------------------------------------------------

_CENTS = "sum(cast(round(o_totalprice * 100) AS BIGINT))"


@query(f"SELECT o_orderpriority AS baseline, count(*) AS n, cast({_CENTS} AS BIGINT) AS cents, {_CENTS}::DOUBLE / count(*) AS mean_cents FROM orders GROUP BY 1")
def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    n = F.count(F.lit(1))
    return _t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("baseline")).agg(n.alias("n"), cents.alias("cents"), (cents.cast("double") / n).alias("mean_cents"))


@query(
    "SELECT o_orderpriority AS baseline, o_orderstatus AS category, cast(grouping(o_orderstatus) AS INTEGER) AS is_total, count(*) AS n, cast(sum(cast(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents "
    "FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, o_orderstatus))"
)
def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("baseline"), F.col("o_orderstatus").alias("category"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    return tables.breakdown(df, "baseline", "category", F.count(F.lit(1)).alias("n"), F.sum("c").alias("cents"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_metrics(spark, sf_dir).select("baseline", F.col("cents").alias("score"))


_SCORES = f"(SELECT o_orderpriority AS baseline, cast({_CENTS} AS BIGINT) AS score FROM orders GROUP BY 1)"


@query(f"SELECT a.baseline AS lhs, b.baseline AS rhs, a.score - b.score AS delta FROM {_SCORES} a, {_SCORES} b")
def delta_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.delta_matrix(_scores(spark, sf_dir))


@query(f"SELECT a.baseline, a.score - b.score AS score_delta FROM {_SCORES} a, {_SCORES} b WHERE b.baseline = '1-URGENT'")
def delta_vs_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.delta_vs(_scores(spark, sf_dir), "1-URGENT")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) <= 25")
def per_group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return tables.per_group_limit(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey"), 25, ["l_returnflag"], order).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 25) ORDER BY o_orderpriority, o_orderkey LIMIT 60")
def head_after_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.head_after_groups(_t(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), 25, 60, "o_orderpriority", ["o_orderkey"])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest(_t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def semi_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return _t(spark, sf_dir, "orders").join(gold, "o_custkey", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, b.n) AS n, b.m AS m FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a "
    "FULL JOIN (SELECT s_nationkey AS k, count(*) AS n, max(s_suppkey) AS m FROM supplier GROUP BY 1) b ON a.k = b.k"
)
def full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1)).alias("n")
    left = _t(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("nation")).agg(n)
    right = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(n, F.max("s_suppkey").alias("m"))
    return tables.merged(left, right, ["nation"], ["n"])


@query("SELECT event_id, event_type, cast(sum(cast(round(value * 100) AS BIGINT)) OVER w AS DOUBLE) / count(*) OVER w AS running_mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_partial_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return metrics.running_mean(df, "cents", ["ts", "event_id"], ["event_type"]).select("event_id", "event_type", "running_mean")


@query("SELECT user_id, event_id, gap_seconds FROM (SELECT user_id, event_id, cast(epoch(lead(date_trunc('second', ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch(date_trunc('second', ts)) AS BIGINT) AS gap_seconds FROM events) WHERE gap_seconds > 900")
def stale_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stale_gaps(_t(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", 900, "event_id").select("user_id", "event_id", "gap_seconds")


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the mean account balance by segment; draws by hash, so there is no SQL twin."""
    return metrics.bootstrap(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", "c_custkey", ["c_mktsegment"])


@query()
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heuristic experiment over the documents as examples, one row a baseline; no single SQL says it."""
    from factloom.plans import experiment
    from factloom.sources.examples import load_examples

    kind = F.col("doc_id") % 3
    paired = _matched(spark, sf_dir)
    source = paired.select(
        F.col("doc_id").cast("string").alias("_id"),
        F.concat(F.lit("What does the board report about cash and dividend: "), F.col("question")).alias("text"),
        F.lit(False).alias("reasoning"),
        F.when(kind == 0, "Governance").when(kind == 1, "Financials").otherwise("Shareholder  Return").alias("category"),
        F.array("text").alias("references"),
        F.col("question").alias("answer"),
        F.lit("qa").alias("type"),
    )
    return experiment.summary(experiment.run(load_examples(source, per_category=None)))


@query("SELECT event_type, cast(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.get_json_object("props", "$.k").cast("long") % 10).alias("k")
    return _t(spark, sf_dir, "events").groupBy("event_type", k).agg(F.count(F.lit(1)).alias("n"))

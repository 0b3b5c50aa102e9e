"""Linking of mentions into property-graph tables.

Nodes are keyed (graph_id, node_id) and edges (graph_id, edge_id).  Row order is data here: first
writers give name, type and profile, last writers the confidence, so every mention carries the
ordinal of its document, its phase (entities before relations) and its place.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import slug
from factloom.sources.staging import staged

UNRESOLVED = "UnresolvedEntity"


def linked_id(name: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Alias if known, else the slug; names without letters or digits get an id of their own hash."""
    made = slug(name)
    made = F.when(made == "", F.concat(F.lit("id_"), F.lower(F.hex(F.xxhash64(name))))).otherwise(made)
    if not aliases:
        return made
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(known[F.lower(F.trim(name))], made)


#: Aliases that are broadcast at most (some 100 bytes each).
BROADCAST_ALIASES = 200_000
#: A name of more than one mention in so many is joined by broadcast, so at most so many are.
HOT_NAMES = 1_000


def with_aliases(mentions: DataFrame, name: str, aliases: DataFrame, broadcast_rows: int = BROADCAST_ALIASES) -> DataFrame:
    """``mentions`` with ``_alias_<name>``, the id that the table (alias, id) has for the name, or null.

    A small table is broadcast.  With a larger one, names are counted first, each different name is
    looked up once, and what is found is joined back: by broadcast for frequent names, else by shuffle.
    Of several ids of an alias, the least counts.
    """
    out, key = f"_alias_{name}", F.lower(F.trim(name))
    known = aliases.select(F.lower(F.trim("alias")).alias("_known"), F.col("id").alias(out)).where("_known IS NOT NULL").groupBy("_known").agg(F.min(out).alias(out))
    if aliases.count() <= broadcast_rows:
        return mentions.join(F.broadcast(known), key == F.col("_known"), "left").drop("_known")
    counted = mentions.groupBy(key.alias("_known")).agg(F.count(F.lit(1)).alias("_n"))
    total = mentions.count()
    found = staged(counted.join(known, "_known"), "aliases")
    hot = found.where(F.col("_n") * HOT_NAMES > total).select(F.col("_known").alias("_hot"), F.col(out).alias("_hot_id"))
    tried = mentions.withColumn("_key", key).join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
    often = tried.where("_hot IS NOT NULL").select(*mentions.columns, F.col("_hot_id").alias(out))
    # A frequent name without an alias takes no part in the join: it has no row to meet.
    unknown = F.broadcast(counted.where(F.col("_n") * HOT_NAMES > total).select(F.col("_known").alias("_often")))
    seldom = tried.where("_hot IS NULL").join(unknown, F.col("_key") == F.col("_often"), "left")
    rest = seldom.where("_often IS NULL").select(*mentions.columns, "_key").join(found.drop("_n"), F.col("_key") == F.col("_known"), "left").select(*mentions.columns, out)
    bare = seldom.where("_often IS NOT NULL").select(*mentions.columns, F.lit(None).cast(found.schema[out].dataType).alias(out))
    return often.unionByName(rest).unionByName(bare)


def raw_id(doc: Column, name: Column, kind: Column) -> Column:
    return F.concat_ws(":", doc, slug(name), slug(kind))


Aliases = Mapping[str, str] | DataFrame | None


def _resolved(entities: DataFrame, relations: DataFrame, aliases: Aliases) -> tuple[DataFrame, DataFrame]:
    if not isinstance(aliases, DataFrame):
        return entities, relations
    for name in ("source_name", "target_name"):
        relations = with_aliases(relations, name, aliases)
    return with_aliases(entities, "name", aliases), relations


def _node_id(linked: bool | str, aliases: Aliases):
    def node_id(name: str, kind: Column) -> Column:
        if isinstance(aliases, DataFrame):
            one = F.coalesce(F.col(f"_alias_{name}"), linked_id(F.col(name)))
        else:
            one = linked_id(F.col(name), aliases)
        other = raw_id(F.col("doc_id"), F.col(name), kind)
        return F.when(F.col(linked), one).otherwise(other) if isinstance(linked, str) else one if linked else other

    return node_id


def node_sets(entities: DataFrame, relations: DataFrame, linked: bool | str = True, aliases: Aliases = None) -> tuple[DataFrame, DataFrame]:
    """((graph_id, node_id, alias), (graph_id, node_id, doc_id)): what ``build`` puts into arrays, a row each.

    A node that many documents name has a row for each of them and no row without bound.
    """
    node_id = _node_id(linked, aliases)
    entities, relations = _resolved(entities, relations, aliases)
    named = entities.select("graph_id", node_id("name", F.col("entity_type")).alias("node_id"), F.col("name").alias("alias"), "doc_id")
    for side in ("source_name", "target_name"):
        named = named.unionByName(relations.select("graph_id", node_id(side, F.lit(UNRESOLVED)).alias("node_id"), F.col(side).alias("alias"), "doc_id"))
    return named.drop("doc_id").distinct(), named.drop("alias").distinct()


def build(entities: DataFrame, relations: DataFrame, linked: bool | str = True, aliases: Aliases = None, sets: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of mentions.

    entities: graph_id, doc_ord, doc_id, profile, pos, name, entity_type, confidence;
    relations: graph_id, doc_ord, doc_id, profile, pos, source_name, relation_type, target_name, confidence.
    Without linking, ids hold document and type, and endpoints never meet typed nodes; ``linked`` may
    name a column that says it for each mention.  Without ``sets`` nodes have no arrays of aliases and
    documents (``node_sets`` has them as rows), which a node named by very many documents needs.
    ``aliases`` may be a table (alias, id) of any size.
    """
    node_id = _node_id(linked, aliases)
    entities, relations = _resolved(entities, relations, aliases)
    at = lambda phase, end: F.struct("doc_ord", F.lit(phase).alias("phase"), "pos", F.lit(end).alias("end"))
    typed = entities.select("graph_id", node_id("name", F.col("entity_type")).alias("node_id"), "name", "entity_type", "profile", "doc_id", "confidence", at(0, 0).alias("ord"))
    ends = relations.withColumns({"source_node_id": node_id("source_name", F.lit(UNRESOLVED)), "target_node_id": node_id("target_name", F.lit(UNRESOLVED))})

    def endpoint(side: str, end: int) -> DataFrame:
        return ends.select("graph_id", F.col(f"{side}_node_id").alias("node_id"), F.col(f"{side}_name").alias("name"), F.lit(UNRESOLVED).alias("entity_type"), "profile", "doc_id", F.lit(None).cast("double").alias("confidence"), at(1, end).alias("ord"))

    events = typed.unionByName(endpoint("source", 0)).unionByName(endpoint("target", 1))
    first = F.min_by(F.struct("name", "entity_type", "profile", (F.col("ord.phase") == 1).alias("relation_only_endpoint")), "ord")
    is_typed = F.col("ord.phase") == 0
    arrays = [F.array_sort(F.collect_set("name")).alias("aliases"), F.array_sort(F.collect_set("doc_id")).alias("source_doc_ids")] if sets else []
    nodes = events.groupBy("graph_id", "node_id").agg(
        first.alias("first"),
        *arrays,
        F.array_sort(F.collect_set(F.when(is_typed, F.col("profile")))).alias("profiles"),
        F.max_by("confidence", F.when(is_typed, F.col("ord"))).alias("last_entity_confidence"),
        F.min("ord").alias("ord"),
    )
    nodes = nodes.select("graph_id", "node_id", "first.*", *(["aliases", "source_doc_ids"] if sets else []), "profiles", "last_entity_confidence", "ord")
    edge_id = F.concat_ws(":", "profile", "doc_id", F.col("pos") + 1, "source_node_id", "relation_type", "target_node_id")
    edges = ends.select("graph_id", edge_id.alias("edge_id"), "source_node_id", "relation_type", "target_node_id", "profile", F.col("doc_id").alias("source_doc_id"), "confidence", F.struct("doc_ord", "pos").alias("ord"))
    return nodes, edges

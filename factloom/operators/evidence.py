"""Ranking of evidence: edges, reference sentences, provenance snippets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import normalize, sentences, tokens


def first_rows(df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def sentence_rows(df: DataFrame, keys: Sequence[str], references: str = "references") -> DataFrame:
    """(keys, pos, sentence) of all references, in order."""
    parts = F.flatten(F.transform(F.coalesce(references, F.array().cast("array<string>")), sentences))
    return df.select(*keys, F.posexplode(parts).alias("pos", "sentence"))


def overlap(a: Column, b: Column) -> Column:
    """How many distinct tokens two token arrays share."""
    return F.size(F.array_intersect(a, b))


def ranked_sentences(df: DataFrame, question: str, references: str = "references", terms: str | None = None, limit: int = 2, name: str = "best") -> DataFrame:
    """``df`` with its best sentences in ``name``, an array of (pos, sentence, edge_overlap, token_overlap, length).

    Ranked in the row by edge terms within, tokens shared with the question and length; ties by place.
    """
    parts = F.flatten(F.transform(F.coalesce(references, F.array().cast("array<string>")), sentences))
    wanted = F.filter(F.array_distinct(F.coalesce(F.col(terms), F.array().cast("array<string>"))), lambda t: t != "") if terms else F.array().cast("array<string>")
    df = df.withColumns({"_q": tokens(F.col(question)), "_terms": wanted, "_lines": F.transform(parts, lambda s, i: F.struct(i.alias("pos"), s.alias("sentence"), normalize(s).alias("s")))})

    def scored(x: Column) -> Column:
        hit = F.size(F.filter("_terms", lambda t: F.contains(x["s"], t)))
        # In the order of the rank: all but the place count downwards.
        return F.struct((-hit).alias("e"), (-overlap(F.split(x["s"], " "), F.col("_q"))).alias("t"), (-F.length(x["sentence"])).alias("l"), x["pos"].alias("pos"), x["sentence"].alias("sentence"))

    # Both are named outside the lambda too: the optimizer would else work them out again for each sentence.
    held = F.when((F.size("_q") >= 0) & (F.size("_terms") >= 0), F.col("_lines"))
    first = F.slice(F.array_sort(F.transform(held, scored)), 1, max(1, limit))
    shown = lambda x: F.struct(x["pos"].alias("pos"), x["sentence"].alias("sentence"), (-x["e"]).alias("edge_overlap"), (-x["t"]).alias("token_overlap"), (-x["l"]).alias("length"))
    return df.withColumn(name, F.transform(first, shown)).drop("_q", "_terms", "_lines")


def reference_sentences(df: DataFrame, keys: Sequence[str], question: str, references: str = "references", terms: str | None = None, limit: int = 2) -> DataFrame:
    """(keys, pos, sentence, edge_overlap, token_overlap, length): the best sentences of each row."""
    return ranked_sentences(df, question, references, terms, limit, "_best").select(*keys, F.inline("_best"))


#: What tells the searches for edges apart.
NAMES = ("source_name", "relation_type", "target_name")


def _normal(lines: Column) -> Column:
    """Sentences (pos, sentence) with their normal form ``s``."""
    return F.transform(lines, lambda x: F.struct(x["pos"].alias("pos"), x["sentence"].alias("sentence"), normalize(x["sentence"]).alias("s")))


def _searches(edges: str, lines: str, limit: int) -> Column:
    """(edge, found) of each of an array of different ``NAMES``: the best of the sentences (pos, sentence, s) in the column ``lines``."""
    searched = lambda e: F.struct(e.alias("edge"), normalize(e["source_name"]).alias("a"), normalize(e["target_name"]).alias("b"), F.array_distinct(F.split(e["relation_type"], "_")).alias("terms"))

    def best(e: Column) -> Column:
        inside = lambda x, name: F.coalesce((name != "") & F.contains(x["s"], name), F.lit(False)).cast("int")

        def scored(x: Column) -> Column:
            ends = inside(x, e["a"]) + inside(x, e["b"])
            words = F.size(F.filter(e["terms"], lambda t: F.contains(x["s"], t)))
            return F.struct((-ends).alias("e"), (-words).alias("r"), (-F.length(x["sentence"])).alias("l"), x["pos"].alias("pos"), x["sentence"].alias("sentence"))

        return F.struct(e["edge"].alias("edge"), F.slice(F.array_sort(F.transform(lines, scored)), 1, limit).alias("found"))

    # Lines are named outside the lambda too: the optimizer would else split and normalize them again for each edge.
    return F.when(F.size(lines) >= 0, F.transform(F.transform(edges, searched), best))


def snippets(edges: DataFrame, sentence_table: DataFrame, key: str, limit: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """The best sentences for each edge (key, edge_id, source_name, relation_type, target_name).

    Edges are told apart by key, edge_id and ``by``.  What they search for is ranked once a key and
    different (source, relation, target), in the row of the key's sentences, and joined back.
    """
    names = list(NAMES)
    lines = sentence_table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("_plain")).withColumn("_lines", _normal(F.col("_plain")))
    sought = edges.select(key, F.struct(*names).alias("_edge")).groupBy(key).agg(F.collect_set("_edge").alias("_edges"))
    rows = sought.join(lines, key)
    found = rows.select(F.col(key).alias("_key"), F.explode(_searches("_edges", "_lines", limit)).alias("_x")).select("_key", F.col("_x.edge").alias("_edge"), F.col("_x.found").alias("_found"))
    same = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_edge.{n}")) for n in names), F.col(key) == F.col("_key"))
    joined = edges.select(*dict.fromkeys([key, *by, "edge_id", *names])).join(found, same)
    shown = joined.select(key, *(c for c in by if c != key), "edge_id", *names, F.explode("_found").alias("_f"))
    return shown.select("*", (-F.col("_f.e")).alias("endpoint_overlap"), (-F.col("_f.r")).alias("relation_overlap"), (-F.col("_f.l")).alias("length"), "_f.pos", "_f.sentence").drop("_f")


def exploded_with_snippets(df: DataFrame, graphs: str, references: str = "references", limit: int = 1) -> DataFrame:
    """A row for each struct of the array ``graphs``, its fields as columns, with ``provenance_snippets`` in its ``triples``.

    The graphs of a row share its references: these are split once, and each different edge is searched for
    once, in the row.  Snippets stand in order of place, as in ``bundle``.
    """
    parts = F.flatten(F.transform(F.coalesce(references, F.array().cast("array<string>")), sentences))
    plain = F.transform(parts, lambda s, i: F.struct(i.alias("pos"), s.alias("sentence")))
    named = lambda t: F.struct(*(t[n].alias(n) for n in NAMES))
    listed = F.flatten(F.filter(F.transform(graphs, lambda g: F.transform(g["triples"], named)), lambda x: x.isNotNull()))
    # References of rows without edges are not split.
    df = df.withColumn("_edges", F.array_distinct(listed)).withColumn("_plain", F.when(F.size("_edges") > 0, plain)).withColumn("_lines", _normal(F.col("_plain")))
    df = df.withColumn("_found", _searches("_edges", "_lines", limit)).drop("_plain", "_edges", "_lines")
    df = df.select("*", F.explode(graphs).alias("_graph")).drop(graphs).select("*", "_graph.*").drop("_graph")

    def held(t: Column) -> Column:
        own = F.get(F.filter("_found", lambda x: x["edge"].eqNullSafe(named(t))), F.lit(0))["found"]
        placed = F.array_sort(F.transform(own, lambda x: F.struct(x["pos"].alias("pos"), x["sentence"].alias("sentence"))))
        return F.coalesce(F.transform(placed, lambda x: x["sentence"]), F.array().cast("array<string>"))

    return df.withColumn("triples", F.transform("triples", lambda t: t.withField("provenance_snippets", held(t)))).drop("_found")


def bundle(used: DataFrame, snippet_rows: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """(keys, triples) of supporting edges with both endpoints known, most confident first, with their snippets if there are ``snippet_rows``."""
    rows = used.where("source_name IS NOT NULL AND target_name IS NOT NULL")
    fields = [(-F.col("confidence")).alias("rank"), "ord", "edge_id", "source_name", "source_type", "relation_type", "target_name", "target_type", "confidence"]
    if snippet_rows is not None:
        held = snippet_rows.groupBy(*keys, "edge_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col("sentence")))).alias("_s"))
        rows = rows.join(held, [*keys, "edge_id"], "left")
        fields.append(F.coalesce(F.transform("_s", lambda x: x["sentence"]), F.array().cast("array<string>")).alias("provenance_snippets"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("triples"))

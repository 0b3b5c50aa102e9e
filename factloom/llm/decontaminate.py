"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed; ``GRAM`` consecutive word hashes make a gram, and of every ``WINNOW`` consecutive
grams the one with the least hash is kept (the leftmost of equals).  Texts that share
GRAM + WINNOW - 1 = 13 consecutive words share a kept gram at the same place of that span, so joining
the kept grams of documents and benchmark items misses no span.  Of a shared span, at least five more
words agree on one side of the gram, so hits and items meet by nine words and not by a common gram of
four.  Each is then extended word by word to both sides, as far as a 13-word window with that gram can
reach.

An item of fewer than 13 words is found whole: all grams of its kind (4 words, or the item's own
length below that) of the documents are looked up, without winnowing, and only if such items exist;
hits meet such items by all of their words.

Cases: null texts have no words; texts of any length that a value can hold are taken whole; an item without words matches nothing; repeated document rows stay
rows of their own; items with equal ids count once; a null item id is written ``null``; empty tables
give no rows, or no hits; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import saved

SPAN, GRAM = 13, 4
#: Words beside a gram that agree on one side of it at least: (13 - 4) / 2, rounded up.
BESIDE = 5
WINNOW = SPAN - GRAM + 1
#: Rows of a side that is broadcast at most (24 bytes each or so); a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Low bits of a kept gram hold its place in the text, the rest its hash.
PLACE_BITS = 30
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of ASCII digits and letters and of all characters beyond ASCII; only A-Z is lower-cased."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, _SEPARATORS), ""), F.array().cast("array<string>"))


def _pairwise(values: str, gap: int, combine) -> Column:
    """combine(v[i], v[i + gap]) for every i that has both."""
    n = F.greatest(F.size(values) - gap, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, gap + 1, n), combine)


def _placed(grams: str) -> Column:
    keep = ~((1 << PLACE_BITS) - 1)
    return F.transform(grams, lambda x, i: x.bitwiseAND(F.lit(keep).cast("long")).bitwiseOR(i.cast("long")))


def _grams(df: DataFrame) -> DataFrame:
    """Adds h, the word hashes, and g1 to g4, the hashes of that many words."""
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("g2", _pairwise("h", 1, lambda x, y: F.xxhash64(x, y)))
    return df.withColumn("g4", _pairwise("g2", 2, lambda x, y: F.xxhash64(x, y)))


def _kept(df: DataFrame) -> DataFrame:
    """Adds kept: the winnowed grams of texts of 13 words or more, with their places."""
    df = df.withColumn("kept", _placed("g4"))
    for gap in (1, 2, 4, 2):  # minima of 2, 4, 8 and 10 grams
        df = df.withColumn("kept", _pairwise("kept", gap, lambda x, y: F.least(x, y)))
    return df.withColumn("kept", F.array_distinct("kept"))


def _all_grams(size: int) -> Column:
    """Every gram of ``size`` words with its place."""
    if size == 1:
        return F.transform("h", lambda x, i: F.xxhash64(x).bitwiseAND(F.lit(~((1 << PLACE_BITS) - 1)).cast("long")).bitwiseOR(i.cast("long")))
    if size == 3:
        n = F.greatest(F.size("h") - 2, F.lit(0))
        pairs = F.zip_with(F.slice("g2", 1, n), F.slice("h", 3, n), lambda x, y: F.xxhash64(x, y))
        return F.transform(pairs, lambda x, i: x.bitwiseAND(F.lit(~((1 << PLACE_BITS) - 1)).cast("long")).bitwiseOR(i.cast("long")))
    return _placed(f"g{size}")


def _hash(kept: str) -> Column:
    return F.shiftright(kept, PLACE_BITS)


def _place(kept: str) -> Column:
    return F.col(kept).bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")).cast("int")


def _around(place: Column) -> list[Column]:
    """The word hashes left of a gram, nearest first, and those from it on."""
    reach = F.least(place, F.lit(WINNOW - 1))
    return [F.reverse(F.slice("h", place - reach + 1, reach)).alias("left"), F.slice("h", place + 1, F.lit(SPAN)).alias("right")]


def _agreeing(a: str, b: str) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.size(same))


def _beside() -> list[Column]:
    """Hashes of a gram with the words beside it, on the left and on the right."""
    return [
        F.when(F.size("left") >= BESIDE, F.xxhash64(F.lit(-1), "gram", F.slice("left", 1, BESIDE))),
        F.when(F.size("right") >= GRAM + BESIDE, F.xxhash64(F.lit(-2), "gram", F.slice("right", GRAM + 1, BESIDE))),
    ]


def _whole(need: Column) -> Column:
    """Hash of the ``need`` words from a gram on."""
    return F.when(F.size("right") >= need, F.xxhash64(need, F.slice("right", F.lit(1), need)))


def _keys(keys: list[Column]) -> Column:
    return F.array_compact(F.array(*keys))


def item_grams(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, need, gram, left, right) of each item's kept grams; need: how many words must agree."""
    df = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0).distinct()
    # Written, so that the grams are not worked out again inside each later expression.
    df = saved(_grams(df), "items")
    n = F.size("h")
    first = F.when(n == 1, _all_grams(1)).when(n == 2, _all_grams(2)).when(n == 3, _all_grams(3)).otherwise(_all_grams(GRAM))
    short = df.where(n < SPAN).withColumn("kept", F.slice(first, 1, 1))
    df = _kept(df.where(n >= SPAN)).unionByName(short)
    df = df.select("item", "h", F.least(n, F.lit(SPAN)).alias("need"), F.explode("kept").alias("kept"))
    return df.select("item", "need", _hash("kept").alias("gram"), *_around(_place("kept")))


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, spans) of every document row.

    spans: the found (item, begin, end) of word places, end excluded, distinct and sorted; words in
    them lie inside an occurrence of a window of that item.
    """
    grams = saved(item_grams(items), "item-grams")
    needs = sorted(r["need"] for r in grams.where(F.col("need") < SPAN).select("need").distinct().collect())  # at most 12 rows
    short = sorted({min(n, GRAM) for n in needs})
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    df = _kept(_grams(keyed.select("id", "text_hash", words(F.col("text")).alias("words"))))
    looked_up = reduce(lambda x, y: F.concat(x, y), [F.col("kept"), *(_all_grams(k) for k in short)])
    df = df.select("id", "text_hash", F.size("words").cast("long").alias("n_words"), looked_up.alias("kept"))
    # The first element marks the document itself, so that one reading gives its words and its grams.
    df = df.select("id", "text_hash", "n_words", F.posexplode(F.concat(F.array(F.col("text_hash")), "kept")).alias("nth", "kept"))
    known = _small(grams.select(F.col("gram").alias("known")).distinct())
    found = df.join(known, (F.col("nth") > 0) & (_hash("kept") == F.col("known")), "left").where("nth = 0 OR known IS NOT NULL")
    found = saved(found.select("id", "text_hash", "n_words", (F.col("nth") == 0).alias("marker"), F.when(F.col("nth") > 0, F.col("kept")).alias("kept")), "kept")

    wanted = found.where("NOT marker").select(F.col("id").alias("its_id"), F.col("text_hash").alias("its_hash"), "kept").distinct()
    by_text = wanted.groupBy("its_id", "its_hash").agg(F.collect_set("kept").alias("kept"))
    by_text = F.broadcast(by_text) if wanted.count() <= BROADCAST_ROWS else by_text
    hit = keyed.join(by_text, F.col("id").eqNullSafe(F.col("its_id")) & F.col("text_hash").eqNullSafe(F.col("its_hash")))
    hit = hit.select("id", "text_hash", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"), "kept")
    around = F.transform("kept", lambda k: _context(k))
    hit = hit.select("id", "text_hash", F.explode(around).alias("at")).select("id", "text_hash", "at.*")
    hit = hit.withColumn("key", F.explode(_keys([*_beside(), *(_whole(F.lit(n)) for n in needs)])))
    of_items = F.when(F.col("need") < SPAN, _keys([_whole(F.col("need"))])).otherwise(_keys(_beside()))
    keyed_items = saved(grams.select("item", "need", F.explode(of_items).alias("key"), F.col("left").alias("item_left"), F.col("right").alias("item_right")), "item-keys")
    pairs = hit.drop("gram").join(_small(keyed_items), "key")
    pairs = pairs.withColumns({"before": _agreeing("left", "item_left"), "after": _agreeing("right", "item_right")}).where("before + after >= need")
    spans = pairs.select("id", "text_hash", F.struct("item", (F.col("place") - F.col("before")).alias("begin"), (F.col("place") + F.col("after")).alias("end")).alias("span")).distinct()
    spans = spans.groupBy(F.col("id").alias("its_id"), F.col("text_hash").alias("its_hash")).agg(F.array_sort(F.collect_list("span")).alias("spans"))
    every = found.where("marker").select("id", "text_hash", "n_words")
    joined = every.join(spans, F.col("id").eqNullSafe(F.col("its_id")) & F.col("text_hash").eqNullSafe(F.col("its_hash")), "left")
    none = F.expr("cast(array() AS array<struct<item: string, begin: int, end: int>>)")
    return joined.select(F.col("id").alias(id_col), "n_words", F.coalesce("spans", none).alias("spans"))


def _context(kept: Column) -> Column:
    """The gram of a kept value, its place, and the word hashes around it."""
    place = kept.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")).cast("int")
    return F.struct(F.shiftright(kept, PLACE_BITS).alias("gram"), place.alias("place"), *_around(place))


def hit_words(spans: str = "spans") -> Column:
    """How many words the spans cover: sorted by begin, each adds what lies beyond the last end."""
    by_begin = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        by_begin,
        start,
        lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(s["end"] - F.greatest(acc["end"], s["begin"]), F.lit(0))).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )


def verdicts(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the contamination verdict of what ``decontaminate`` returns."""
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    df = found.withColumns({"n_hit": hit_words(), "items": items})
    return df.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), item_window AS (
  SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), doc_window AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)
), found AS (
  SELECT DISTINCT doc_id, item_id, i, d.n AS n FROM doc_window d JOIN item_window USING (n, t)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id
)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

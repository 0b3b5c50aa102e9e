"""The corpus pipeline: five stages over the documents, each an operator of ``factloom.llm``.

1. quality: documents that the positive-unlabelled classifier rejects go.
2. toxicity: documents that the subword classifier calls toxic go.
3. near duplicates: of each group that SimHash links, the row with the smallest id stays; of different
   texts under that id, the one with the least hash.
4. decontamination: documents contaminated by the benchmark go.
5. tokens: what is left, as token ids.

Stages 3 and 4 decide by row, which id and text tell apart: of two rows with one id, one may stay.  In
stage 3 a row goes only if its group keeps another, null ids come last, and of rows with equal id and
text one stays.
Empty tables pass as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, quality, simhash, toxicity
from factloom.llm.registry import tokenizer_path
from factloom.llm.shared import discard, fresh, saved, table

#: Pairs of id and text hash that are broadcast at most (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``key``, by which rows are told apart: whether the id is null, the id, the text's hash."""
    return docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.xxhash64("text").alias("text_hash")))


def _matched(rows: DataFrame, key: str, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with the keys in ``keys`` (one column ``key``) as ``how`` says, by broadcast while they are few."""
    its_id, its_hash = fresh("its_id", rows), fresh("its_hash", rows)
    pairs = saved(keys.select(F.col(f"{key}.doc_id").alias(its_id), F.col(f"{key}.text_hash").alias(its_hash)).distinct(), "keys")
    pairs = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
    return rows.join(pairs, F.col(f"{key}.doc_id").eqNullSafe(F.col(its_id)) & (F.col(f"{key}.text_hash") == F.col(its_hash)), how)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, score = quality.fit(docs, table(spark, sf_dir, "labels")), fresh("score", docs)
    return quality.with_score(docs, model, name=score).where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), fresh("score", docs)
    return toxicity.with_score(docs, model, name=score).where(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The least key of a group names it: null ids last, then the smaller id, then the lesser hash.
    key = fresh("key", docs)
    keyed = _keyed(docs, key)
    grouped = saved(simhash.near_duplicates(keyed, key), "groups")
    left = _matched(keyed, key, grouped.where(F.col(key) != F.col("component_id")), "left_anti")
    repeated = saved(grouped.where(F.col(key) == F.col("component_id")).groupBy(key).count().where("count > 1").select(key), "repeated")
    if repeated.isEmpty():
        return left.select(docs.columns)
    once = _matched(left, key, repeated, "left_semi").dropDuplicates([key])
    return _matched(left, key, repeated, "left_anti").unionByName(once).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = fresh("key", docs)
    keyed = _keyed(docs, key)
    found = decontaminate.verdicts(decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col=key), id_col=key)
    return _matched(keyed, key, found.where("contaminated").select(key), "left_anti").select(docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs, tokenizer_path(), decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", to_tokens),
]

#: SQL can express neither the classifiers nor XXH64; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            discard(before)
    return docs

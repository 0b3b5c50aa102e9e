"""The driver queries of the training-data operators, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, chat, dac, decontaminate, html_text, personal, quality, simhash, spelling, structure, topk, toxicity, warc
from factloom.llm.labelled import fold
from factloom.llm.shared import shared_dir, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the token files."""
    manifest = dac.write(table(spark, sf_dir, "documents"), shared_dir(spark, "tokens"), tokenizer_path())
    return dac.checksums(dac.read(spark, manifest))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that occur in benchmark items, and the verdict."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.verdicts(found)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives."""
    folder = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.pages(warc.read(spark, folder))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.with_text(pages, model=html_text.fit(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a preference pair."""
    return chat.digests(chat.preferences(chat.swapped_pairs(chat.conversations(table(spark, sf_dir, "conversations")))))


def _scored(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", (fold() == 0).alias("held_out"), F.col("score"), (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(quality.with_score(docs.select("doc_id", "text"), model, name="score"), quality.THRESHOLD)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.with_score(docs.select("doc_id", "text"), model, name="score"), toxicity.THRESHOLD)


def op11_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired: faults, cheapest edits and the digest of the result."""
    return structure.report(table(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the damaged documents with its near words, its form and its root."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the fixed spans, and those that the boosted trees add."""
    docs = table(spark, sf_dir, "documents")
    return personal.report(personal.with_spans(docs.select("doc_id", "text"), personal.fit(docs)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline from documents to tokens."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).drop("ids")


_QUERIES = [op1_exact_topk, op2_bpe, op3_simhash, op4_token_files, op5_decontaminate, op6_warc, op7_html, op8_chat, op9_quality, op10_toxicity, op11_structure, op12_spelling, op13_personal, pipeline]
_ORACLES: dict[str, str] = {"op1_exact_topk": topk.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op6_warc": warc.ORACLE, "op8_chat": chat.ORACLE, "op11_structure": structure.ORACLE, "op12_spelling": spelling.oracle(structure.crc_sql)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)

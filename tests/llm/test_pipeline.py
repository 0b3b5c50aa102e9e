"""Pipeline stages on a small table with nulls, repeats and clashing columns."""

import corpus_pipeline as pipeline
import pytest

from factloom.llm import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    passage = " ".join(f"item{i}" for i in range(30))
    base = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    rows = [(i, t, "en", "s") for i, t in enumerate(base)]
    rows += [(100, base[3], "en", "s"), (101, base[3], None, None), (102, passage, "en", "s"), (103, None, "en", None), (103, None, "en", None), (None, "a text without id", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS score", "length(text) AS n_chars").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = pipeline.drop_near_duplicates(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [*range(40), 102, 103]
    clean = pipeline.drop_contaminated(spark, docs, folder)
    assert 102 not in [r.doc_id for r in clean.collect()] and clean.count() == docs.count() - 1 and clean.columns == docs.columns
    assert pipeline.drop_toxic(spark, docs, folder).count() == docs.count()  # no toxic label: nothing to learn, nothing goes
    assert pipeline.keep_good(spark, docs, folder).columns == docs.columns
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_names():
    names = list(registry.queries())
    assert [n for n, _ in pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "tokens"]
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}

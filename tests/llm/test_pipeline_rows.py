"""The near-duplicate and decontamination stages decide by row, not by id."""

import corpus_pipeline as pipeline


def test_repeated_and_null_ids(spark):
    a, b, c, d, e = (" ".join(f"w{i}x{j}" for j in range(60)) for i in range(5))
    rows = [(1, a), (5, a), (5, b), (6, c), (6, d), (6, d), (None, a), (None, e), (None, e), (8, None), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS _other", "1 AS component_id")
    for some in (docs.repartition(1), docs.repartition(5)):
        kept = pipeline.drop_near_duplicates(spark, some, "")
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (5, b), (6, c), (6, d), (None, e), (8, None)], key=str)


def test_a_clean_row_stays_though_its_id_has_a_contaminated_one(spark, tmp_path):
    passage = " ".join(f"item{i}" for i in range(30))
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, passage), (1, "clean words only"), (None, passage + " and more"), (None, "clean too"), (2, None), (2, None), (3, passage), (3, passage), (4, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS its_id", "2 AS n_words")
    kept = pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "clean words only"), (None, "clean too"), (2, None), (2, None), (4, "a")], key=str)

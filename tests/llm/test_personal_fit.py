"""The fit takes every document and every span."""

from pyspark.sql import functions as F

from factloom.llm import personal


def test_the_fit_leaves_no_example_out(spark, monkeypatch):
    n, held = 4_100, {}
    saved = personal.saved
    monkeypatch.setattr(personal, "saved", lambda df, name: held.setdefault(name, saved(df, name)))
    personal.fit(spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("write to ann"), "id", F.lit("@example.org or so, 2019-11-20 10.10")).alias("text")))
    of = {r.label: r.n for r in held["fit-examples"].groupBy("label").agg(F.sum("n").alias("n")).collect()}
    assert of[1.0] == n * len(personal.DISGUISES["email"]) and of[0.0] >= n
    assert held["fit-examples"].count() < n

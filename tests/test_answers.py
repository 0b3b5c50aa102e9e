"""The shared answerer and the serialised contexts."""

from pyspark.sql import functions as F

from factloom.operators import answers

TRIPLE = "struct<source_name: string, source_type: string, relation_type: string, target_name: string, target_type: string, confidence: double, provenance_snippets: array<string>>"


def test_modes(spark):
    triple = ("Ann", "Person", "holds_role", "Chair", "OfficerRole", 0.71, [" Ann is chair. ", "x"])
    rows = [("question_only", None, None, []), ("reference_only", ["a.", " ", "b."], None, []), ("reference_only", None, None, []), ("graph_evidence_bundle", None, [triple], ["slot"]), ("graph_evidence_bundle", None, None, ["slot"]), ("graph_evidence_bundle", None, None, [])]
    df = spark.createDataFrame(rows, f"mode string, s array<string>, t array<{TRIPLE}>, m array<string>").withColumn("q", F.lit(" Who? "))
    text, sure = answers.shared(F.col("mode"), F.col("s"), F.col("t"), F.col("m"))
    ctx = answers.context(F.col("mode"), F.col("q"), F.lit("intent"), F.col("s"), F.col("t"), F.col("m"))
    got = df.select(text.alias("a"), sure.alias("c"), ctx.alias("x")).collect()
    assert [(r.a, r.c) for r in got] == [
        ("Insufficient grounded context to answer from the question alone.", 0.12),
        ("a. b.", 0.35),
        ("Reference context did not provide grounded answer text.", 0.35),
        ("Graph-grounded evidence: Ann holds role Chair.", 0.42),
        ("Graph evidence is incomplete. Missing slots: slot.", 0.18),
        ("Graph evidence did not provide grounded triples for this question.", 0.18),
    ]
    assert got[1].x == "[Question]\nWho?\n\n[Context Mode]\nreference_only\n\n[Reference Sentences]\n- a.\n- b."
    assert got[3].x.endswith("[Entities]\n- Ann (Person)\n- Chair (OfficerRole)\n\n[Triples]\n- Ann (Person) --holds_role--> Chair (OfficerRole) [confidence=0.71]\n\n[Provenance Snippets]\n- Ann is chair.\n- x\n\n[Missing Slots]\n- slot")
    assert "[Triples]\n- None" in got[5].x

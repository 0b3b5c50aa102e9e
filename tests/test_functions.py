"""Text functions, metrics and graph rules on tiny tables."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions.numbers import rounded
from factloom.operators import evidence, graph, metrics, profiles, quality, support, tables
from factloom.plans import dims


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def test_text(spark):
    t = F.col("t")
    assert one(spark, X.normalize(t), t="  Éa--B c_9 ") == "a b c 9"
    assert one(spark, X.slug(t), t=" Net  Income! ") == "net_income"
    assert one(spark, X.sentences(t), t="A b. C d! e? F") == ["A b.", "C d! e?", "F"]
    assert one(spark, X.first_sentence(t), t="It is so. Then more") == "It is so."
    assert one(spark, X.first_sentence(t), t="") == "" and one(spark, X.first_sentence(t), t="Hello there.\n") == "Hello there." and one(spark, X.first_sentence(t), t=" no stop") == "no stop."
    assert one(spark, X.sentences(t), t="A b.\nC d.\n\t") == ["A b.", "C d."] and one(spark, X.sentences(t), t="\u00a0One.\u2003Two? x\x85") == ["One.", "Two? x"]
    assert one(spark, X.confidence(t), t="0.12345678") == 0.123 and one(spark, X.confidence(t), t="1234567890123") == 1.0
    assert one(spark, X.first_of_each(F.split(t, ",")), t="b,A,a,B,c,A") == ["b", "A", "c"]
    assert one(spark, X.persons(t), t="Ann B. Lee met ann lee and Bob Ray") == ["Ann B. Lee", "Bob Ray"]
    assert one(spark, X.amounts(t), t="paid USD 5 billion, usd 5 BILLION and 4") == ["USD 5 billion"]
    assert one(spark, X.periods(t), t="FY2024, Q1 2023, q1 2023, 2024") == ["2023", "2024", "FY2024", "Q1 2023", "q1 2023"]
    assert one(spark, X.company(t), t="the Acme  Trade Inc. said") == "Acme Trade Inc."
    assert one(spark, X.company(t), t="nobody") is None
    assert one(spark, X.confidence(t), t="about 85 percent") == 0.85
    assert one(spark, X.confidence(t), t="Very High") == 0.85
    assert one(spark, X.confidence(t), t="none") == 0.4
    assert one(spark, X.lenient_json(t, "a int")["a"], t='noise {"a": 3} more') == 3
    assert one(spark, X.truncated(t, 11), t="one two three") == "one two" + X.TRUNCATED
    assert one(spark, X.relation_phrase(t, dims.RELATION_PHRASES), t="made_up_link") == "made up link"


def test_profiles_ties_and_defaults(spark):
    df = spark.createDataFrame([(1, "board and revenue"), (2, "nothing"), (3, None)], "id int, t string")
    got = {r.id: (r.selected_profile, r.profile_score) for r in profiles.by_keywords(df, F.coalesce("t", F.lit("")), dims.PROFILE_KEYWORDS, F.lit("financials")).collect()}
    assert got == {1: ("governance", 1), 2: ("financials", 0), 3: ("financials", 0)}
    assert one(spark, profiles.intent(F.lit("financials"), F.col("t"), dims.INTENTS, dims.DEFAULT_INTENTS), t="the notes and debt") == "financials_debt_profile"
    assert one(spark, profiles.intent(F.lit("governance"), F.col("t"), dims.INTENTS, dims.DEFAULT_INTENTS), t="zzz") == "governance_board_structure"


def test_quality_rules(spark):
    node = "graph_id string, node_id string, aliases array<string>"
    nodes = spark.createDataFrame([("g", "a", ["X", "x"]), ("g", "b", ["Y"]), ("g", "c", ["Z"]), ("g", "d", ["y"])], node)
    edges = spark.createDataFrame(
        [("g", "1", "a", "holds_role", "gone", "governance"), ("g", "2", "b", "bad", "a", "governance"), ("g", "3", "c", "chairs", "c", "governance"), ("h", "4", "a", "chairs", "b", "governance")],
        "graph_id string, edge_id string, source_node_id string, relation_type string, target_node_id string, profile string",
    )
    allowed = spark.createDataFrame([("governance", "holds_role"), ("governance", "chairs")], "profile string, relation_type string")
    got = {(r.graph_id, r.issue_type, r.object_id) for r in quality.analyze(nodes, edges, allowed).collect()}
    assert got == {("g", "duplicate_alias", "x"), ("g", "duplicate_alias", "y"), ("g", "dangling_edge", "1"), ("h", "dangling_edge", "4"), ("g", "schema_violation", "2"), ("g", "disconnected_node", "d")}
    assert {r.edge_id for r in quality.without_issues(edges, quality.analyze(nodes, edges, allowed)).collect()} == {"3"}


def test_support_slots_and_empty_requirements(spark):
    nodes = spark.createDataFrame([("g", "p", "Ann Lee", "Person"), ("g", "r", "Chief", "OfficerRole"), ("g", "s", "Head", "OfficerRole")], "graph_id string, node_id string, name string, entity_type string")
    rows = [("g", str(i), "p", "holds_role", t, "governance", 0.7, i) for i, t in ((1, "r"), (2, "s"))]
    edges = spark.createDataFrame(rows, "graph_id string, edge_id string, source_node_id string, relation_type string, target_node_id string, profile string, confidence double, ord int")
    ask = "graph_id string, question_id string, target_profile string, intent_id string, required_relations array<string>, required_entity_types array<string>, focus_slots array<string>"
    questions = spark.createDataFrame(
        [("g", "q1", "governance", "governance_role_transition", ["holds_role"], ["Person", "Board"], ["person", "current_role", "prior_role"]), ("g", "q2", "governance", "none", [], [], []), ("g", "q3", "financials", "none", ["holds_role"], [], [])], ask
    )
    got = {r.question_id: r for r in support.analyze(questions, edges, nodes, dims.SLOT_HINTS, edge_ids=True).collect()}
    assert {r.question_id: r.n_edges for r in support.analyze(questions, edges, nodes, dims.SLOT_HINTS).collect()} == {"q1": 2, "q2": 0, "q3": 0}
    assert got["q1"].filled_slots == ["current_role", "person", "prior_role"] and got["q1"].missing_requirements == ["entity_type:Board"]
    assert got["q1"].support_score == pytest.approx(5 / 6) and got["q1"].supporting_edge_ids == ["1", "2"]
    assert (got["q2"].support_score, got["q2"].answerable) == (0.0, True)
    assert (got["q3"].support_score, got["q3"].answerable) == (0.0, False)


def test_linking_order_does_not_depend_on_partitions(spark):
    e = spark.createDataFrame([("g", i, f"d{i}", "p", 0, n, t, c) for i, (n, t, c) in enumerate([("Net Income", "A", 0.1), ("net income", "B", 0.9), ("***", "C", 0.5)])], "graph_id string, doc_ord int, doc_id string, profile string, pos int, name string, entity_type string, confidence double")
    r = spark.createDataFrame([("g", 0, "d0", "p", 0, "Net-Income", "is", "New", 0.4)], "graph_id string, doc_ord int, doc_id string, profile string, pos int, source_name string, relation_type string, target_name string, confidence double")
    for n in (1, 5):
        nodes, edges = graph.build(e.repartition(n), r.repartition(n))
        got = {x.node_id: (x.name, x.entity_type, x.last_entity_confidence, x.aliases) for x in nodes.collect()}
        assert got["net_income"] == ("Net Income", "A", 0.9, ["Net Income", "Net-Income", "net income"])
        assert got["new"][1] == "UnresolvedEntity" and len(got) == 3
        assert edges.first().edge_id == "p:d0:1:net_income:is:new"


def test_metrics(spark):
    df = spark.createDataFrame([(1, "a a b", "a b b"), (2, "", "x"), (3, None, None)], "id int, l string, r string")
    got = {r.id: round(r.token_f1, 4) for r in metrics.token_f1(df, ["id"], "l", "r").collect()}
    assert got == {1: 0.6667, 2: 0.0, 3: 0.0}
    scores = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "baseline string, score double")
    matrix = {(r.lhs, r.rhs): r.delta for r in metrics.delta_matrix(scores).collect()}
    assert matrix[("a", "b")] == -matrix[("b", "a")] == 2.0
    values = spark.createDataFrame([("g", i, float(i)) for i in range(20)] + [("h", 0, 5.0)], "k string, id int, v double")
    ci = {r.k: r for r in metrics.bootstrap(values, "v", "id", ["k"], 200).collect()}
    assert ci["g"].low <= ci["g"].mean <= ci["g"].high and ci["g"].n == 20
    assert (ci["h"].low, ci["h"].mean, ci["h"].high) == (5.0, 5.0, 5.0)


def test_tables_and_evidence(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, seq int, v string")
    assert {(r.k, r.v) for r in tables.latest(df, ["k"], ["seq"]).collect()} == {("a", None), ("b", "y")}
    docs = spark.createDataFrame([("d", "which cat sat", ["The cat sat. A dog ran far away here. Cat."])], "id string, q string, references array<string>")
    best = evidence.reference_sentences(docs, ["id"], "q", limit=1).first()
    assert (best.sentence, best.token_overlap) == ("The cat sat.", 2)


def test_rounding_is_that_of_the_binary_value(spark):
    import random

    random_ = random.Random(1)
    values = [0.0005, 0.0015, 2.0005, 2.675, 0.9545, -0.0025, 0.125, 0.0625, 1.0, 0.0, 1e9 + 0.0005, -2.3455, 0.1 + 0.2] + [random_.uniform(-3, 3) for _ in range(500)] + [random_.randint(-5000, 5000) / 2000 for _ in range(500)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", rounded(F.col("v")).alias("three"), rounded(F.col("v"), 1).alias("one")).orderBy("i").collect()
    assert [(r.three, r.one) for r in got] == [(round(v, 3), round(v, 1)) for v in values]
    assert spark.range(1).select(rounded(F.lit(None).cast("double")).alias("x")).first().x is None


def test_running_sums_over_ranges(spark):
    rows = [(k, i, float(i * i % 7) if i % 5 else None) for k in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(7)
    got = {(r.k, r.i): r.running_mean for r in metrics.running_mean(df, "v", ["i"], ["k"]).collect()}
    for k in ("a", "b", None):
        total, n = 0.0, 0
        for i in range(60):
            if i % 5:
                total, n = total + i * i % 7, n + 1
            assert got[(k, i)] == (pytest.approx(total / n) if n else None)
    steps = metrics.checkpoints(df.where("k IS NOT NULL"), ["k"], ["i"], ["v"], 25).where("k = 'a'").orderBy("processed").collect()
    assert [(r.processed, r.total) for r in steps] == [(25, 60), (50, 60), (60, 60)]
    assert steps[0].v == round(sum(i * i % 7 for i in range(25) if i % 5) / 20, 3)


def test_annotation_and_priority(spark):
    nodes = spark.createDataFrame([("g", "a"), ("g", "b")], "graph_id string, node_id string")
    edges = spark.createDataFrame([("g", "1"), ("g", "2")], "graph_id string, edge_id string")
    issues = spark.createDataFrame([("g", "disconnected_node", "node", "a"), ("g", "schema_violation", "edge", "1"), ("g", "dangling_edge", "edge", "1")], "graph_id string, issue_type string, object_type string, object_id string")
    used = spark.createDataFrame([("g", "q1", "2"), ("g", "q0", "2")], "graph_id string, question_id string, edge_id string")
    n, e = quality.annotated(nodes, edges, issues, used)
    assert {r.node_id: r.quality_issues for r in n.collect()} == {"a": ["disconnected_node"], "b": None}
    assert {r.edge_id: (r.quality_issues, r.query_support) for r in e.collect()} == {"1": (["dangling_edge", "schema_violation"], None), "2": (None, ["q0", "q1"])}
    low, high = spark.createDataFrame([("x", 1), ("y", 1)], "k string, v int"), spark.createDataFrame([("y", 2), ("z", 2)], "k string, v int")
    assert {(r.k, r.v) for r in tables.merged_by_priority([low, high], ["k"]).collect()} == {("x", 1), ("y", 2), ("z", 2)}
    matrix = metrics.delta_maps(metrics.delta_matrix(spark.createDataFrame([("a", 3.0), ("b", 1.0)], "baseline string, score double")))
    assert {r.lhs: r.deltas for r in matrix.collect()} == {"a": {"a": 0.0, "b": 2.0}, "b": {"a": -2.0, "b": 0.0}}

"""The experiment, its sources, sinks and reports on tiny tables."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import answers as answering
from factloom.operators import backend, extract
from factloom.plans import experiment, exports, reports
from factloom.sources import examples, runs, sinks
from factloom.streaming import progress

SOURCE = "_id string, text string, reasoning boolean, category string, references array<string>, answer string, type string"
ROWS = [
    ("e1", "Who chairs the board and the audit committee, and what role?", True, "Governance", ["Acme Inc. said Ada Cole is Chief Executive Officer and chair. Tom Reed and Lena Moss sit on the audit committee."], "Ada Cole chairs.", "x"),
    ("e2", "How did revenue change from 2023 to 2024?", False, " financials ", ["Acme Corporation reported revenue of $5 billion in 2024.", "b", "c"], "Revenue grew to $5 billion in 2024.", "x"),
    ("e3", "What dividend policy and repurchase?", None, "Shareholder  Return", None, "The dividend and buyback continue.", "x"),
    ("e4", "?", None, "Other", [], "x", "x"),
]


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(ROWS, SOURCE)


def test_loading(spark, source):
    got = {r.example_id: r for r in examples.load_examples(source).collect()}
    assert set(got) == {"e1", "e2", "e3"} and got["e2"].references[1:] == ["b"] and got["e3"].source_text == ROWS[2][1]
    assert [r.example_id for r in examples.load_examples(source, sample=1).collect()] == ["e2"]
    with pytest.raises(ValueError, match="answer"):
        examples.require(source.drop("answer"))
    assert examples.manual_gold(spark, None).count() == 0


def test_run(spark, source):
    rows = experiment.run(examples.load_examples(source)).collect()
    assert len(rows) == 18
    full = {r.example_id: r for r in rows if r.baseline.startswith("full")}
    weak = {r.example_id: r for r in rows if r.baseline == "graph_without_ontology_constraints"}
    assert full["e3"].support_score == 1.0 and full["e3"].answerable and full["e3"].extraction_f1 == 0.4
    assert all(r.support_score == 0.0 and not r.answerable for r in weak.values())
    assert full["e2"].answer.startswith("Graph-grounded evidence indicates: Acme Corporation reports Revenue; Revenue for period 2024.")
    assert weak["e3"].n_entities == 1 and weak["e3"].n_relations == 1
    assert all(r.n_issues is not None for r in rows if r.baseline in experiment.GRAPH_BASELINES)
    assert {r.evaluation_gold_source for r in rows if r.baseline in experiment.GRAPH_BASELINES} == {"induced_proxy"} and full["e2"].answer_generation_mode == "heuristic_local"


def test_manual_gold_and_backend(spark, source):
    gold = spark.createDataFrame([("e3", [("Dividend", "Dividend"), ("Other", "X")], [])], "example_id string, gold_entities array<struct<name: string, entity_type: string>>, gold_relations array<struct<source_name: string, relation_type: string, target_name: string>>")

    def model(requests):
        if requests[0]["task"] == "profile":
            return ['{"selected_profile": "shareholder_return"}' if r["example_id"] == "e3" else "?" for r in requests]
        if requests[0]["task"] == "extraction":
            return [None if r["example_id"] != "e1" else '{"entities": [{"name": "Ann", "entity_type": "Person"}], "relations": []}' for r in requests]
        assert all(r["task"] == "answer" and r["temperature"] == 0.0 and json.loads(r["prompt"])["context_text"] for r in requests)
        return ['{"answer": " Said. ", "confidence": "85 percent", "quality_notes": ["sure"]}' if r["example_id"] == "e3" else "no json" for r in requests]

    rows = experiment.run(examples.load_examples(source), manual=gold, backend=model)
    found = {(r.baseline, r.example_id): r for r in rows.collect()}
    full = found[("full_minimal_pipeline_with_quality_aware_evidence_selection", "e3")]
    assert (full.evaluation_gold_source, full.answer, full.confidence, full.quality_notes, full.answer_generation_mode) == ("manual_gold", "Said.", 0.85, ["sure"], "openai_answer_agent")
    one = found[("full_minimal_pipeline_with_quality_aware_evidence_selection", "e1")]
    assert (one.n_entities, one.n_relations) == (1, 0) and full.selected_profile == "shareholder_return"
    assert full.extraction_f1 == 0.2  # one of three entities, of two gold ones; relations without gold
    other = found[("reference_only_baseline", "e2")]
    assert other.answer_generation_mode == "heuristic_answer_fallback" and other.answer_fallback_reason == "missing worker result" and other.answer.startswith("Acme")
    kept = experiment.details(rows, 1).collect()
    assert len(kept) == 6 and {r.example_id for r in kept} == {"e1"} and kept[0].answer.question_id == "e1"
    parts = experiment.partial_summary(rows, 2).where("baseline = 'reference_only_baseline'").orderBy("processed").collect()
    assert [(r.processed, r.total) for r in parts] == [(2, 3), (3, 3)] and parts[0].extraction_f1 is None
    table = {r.baseline: r for r in experiment.summary(rows).collect()}
    assert table["question_only_baseline"].answer_quality_delta_vs_question_only == 0.0 and table["question_only_baseline"].n_issues is None


def test_backend_tasks(spark):
    df = spark.createDataFrame([("x", "governance", 0.6, [], [])], "source_text string, selected_profile string, selection_confidence double, entities array<struct<name: string, entity_type: string, confidence: double>>, relations array<struct<source_name: string, relation_type: string, target_name: string, confidence: double>>")
    asked = backend.requests(df, "extraction", F.col("selected_profile")).first()
    assert json.loads(asked.prompt)["allowed_relation_types"] == ["holds_role", "chairs", "serves_on_committee"]
    assert json.loads(backend.requests(df, "profile").first().prompt)["allowed_profiles"][0] == "governance"
    answer = lambda text: df.withColumns({"response": F.lit(text), "response_error": F.lit(None).cast("string")})
    good = backend.choose_extraction(answer('ok {"entities": [{"name": "A", "entity_type": "T"}, {"entity_type": "T"}], "relations": [{"source_name": "A", "relation_type": "r", "target_name": "B"}]}'), "response").first()
    assert [tuple(e) for e in good.entities] == [("A", "T", 0.8)] and [tuple(r) for r in good.relations] == [("A", "r", "B", 0.78)] and good.extraction_mode == "openai"
    assert backend.choose_extraction(answer("nothing"), "response").first().extraction_mode == "heuristic_fallback"
    chosen = backend.choose_profile(answer('{"selected_profile": "financials", "rationale": "r"}'), "response").first()
    assert (chosen.selected_profile, chosen.selection_confidence, chosen.ontology_rationale) == ("financials", 0.7, "r")
    kept = backend.choose_profile(answer('{"selected_profile": "odd"}'), "response").first()
    assert kept.selected_profile == "governance" and "Heuristic fallback used" in kept.ontology_rationale
    failed = spark.createDataFrame([("ValueError: x", ["r" * 500], "q"), ("E", [], "q"), (None, [], "q")], "e string, r array<string>, q string").select(answering.after_error(F.col("e"), F.col("r"), F.col("q")).alias("a")).collect()
    assert (failed[0].a.answer, failed[0].a.confidence, failed[0].a.quality_notes) == ("r" * 400, 0.08, ["Runtime exception fallback: ValueError: x"]) and failed[1].a.answer == "q" and failed[2].a is None


def test_extraction_order_and_case(spark):
    df = spark.createDataFrame([("governance", "Ann Lee, ann lee and Bob Ray: the Chair and director of Big Co Company"), ("nobody", "cash flow of 7 segment")], "selected_profile string, source_text string")
    gov, fin = (r for r in extract.extract(df).collect())
    assert [e.name for e in gov.entities] == ["Chair and director of Big Co Company", "Ann Lee", "Bob Ray", "Big Co", "Director", "Chair"]
    assert [(r.source_name, r.relation_type) for r in gov.relations][-1] == ("Ann Lee", "chairs")
    assert [e.name for e in fin.entities] == ["Referenced Company", "Cash", "Segment"]


def test_sinks_and_reports(spark, source, tmp_path):
    counts = {r.category: r.n for r in sinks.ingest(source, str(tmp_path / "kept")).collect()}
    assert counts == {"Governance": 1}  # this filter does not trim or collapse blanks
    answers = spark.createDataFrame([("r", "b:1", "x", 0.5, '{"token_f1": 0.5, "support_score": 1, "answerable": true}'), ("r", "b:2", "y", 0.7, '{"token_f1": 1.0, "support_score": 0, "answerable": false}')], "run_id string, question_id string, category string, answer_confidence double, evaluation_json string")
    sinks.upsert(answers, str(tmp_path), "question_answers", 1)
    sinks.upsert(answers.where("category = 'x'").withColumn("answer_confidence", F.lit(0.9)), str(tmp_path), "question_answers", 2)
    now = sinks.current(spark, str(tmp_path), "question_answers")
    got = {(r.baseline, r.category): r for r in reports.snapshot(now).collect()}
    assert got[("b", None)].example_count == 2 and got[("b", None)].avg_answer_confidence == 0.8 and got[("b", "x")].answerable_rate == 1.0
    artifact = {"example_id": "1", "profile_decision": {"selected_profile": "governance"}, "extraction": {"entities": [{"name": "a", "entity_type": "T"}], "relations": [{"source_name": "a", "relation_type": "chairs", "target_name": "b"}, {"source_name": "a", "relation_type": "odd", "target_name": "b"}]}, "answer": {"category": "Governance", "token_f1": 0.5, "answer": "Ann leads"}, "query_support": {"support_score": 0.5, "filled_slots": ["s"], "intent_id": "i"}}
    folder = tmp_path / "art" / "baseline=graph_with_profile_selection_only"
    folder.mkdir(parents=True)
    (folder / "1.json").write_text(json.dumps(artifact))
    art = examples.artifacts(spark, str(tmp_path / "art"), reports.ARTIFACT)
    flat = reports.records(art).first()
    assert (flat.entity_count, flat.relation_count, flat.allowed_relation_ratio, flat.filled_slot_count, flat.quality_issue_count) == (1, 2, 0.5, 1, 0)
    assert reports.baseline_summary(reports.records(art)).first().avg_relation_count == 2.0
    scored = spark.createDataFrame([("graph_with_profile_selection_only", "1", "Governance", 0.5), ("reference_only_baseline", "1", "Governance", 0.3)], "baseline string, doc_id string, category string, token_f1 double")
    row = {r.baseline: r for r in reports.metric_rows(scored, art).collect()}["graph_with_profile_selection_only"]
    assert (row.answer_quality_delta, row.profile_selection_accuracy, row.relation_schema_conformance_rate, row.fallback_error_rate) == (0.2, 1.0, 0.5, 0.0)
    gold = spark.createDataFrame(
        [("1", "Governance", "governance", "i", [], ["ann", "bob"], [("A!", "T"), ("b", "T")], [("a", "chairs", "b")]), ("2", "Governance", "governance", "i", [], [], [], [])],
        "example_id string, category string, gold_profile string, intent_id string, required_answer_slots array<string>, preferred_answer_evidence array<string>, gold_entities array<struct<name: string, entity_type: string>>, gold_relations array<struct<source_name: string, relation_type: string, target_name: string>>",
    )
    scores = reports.manual_gold_scores(art, gold)
    judged = scores.first()
    assert judged.profile_match and judged.intent_match and judged.required_slot_coverage is None and judged.preferred_evidence_hit_rate == 0.5
    assert (judged.entity_precision, judged.entity_recall, judged.entity_f1, judged.relation_f1, judged.extraction_f1_manual) == (1.0, 0.5, 0.667, 0.667, 0.667)
    missing = reports.manual_gold_missing(art, gold)
    assert [tuple(r) for r in missing.collect()] == [("graph_with_profile_selection_only", "2")]
    table = reports.manual_gold_summary(scores, missing).first()
    assert (table.sample_count, table.missing_artifact_count, table.ontology_constrained_extraction_f1_manual, table.required_answer_slot_coverage_manual) == (1, 1, 0.667, None)
    assert reports.profile_histogram(reports.records(art)).first().n == 1
    assert reports.delta_table(reports.baseline_summary(reports.records(art)), "graph_with_profile_selection_only").first().avg_relation_count_delta == 0.0
    assert reports.artifact_extraction_f1(art).first().ontology_constrained_extraction_f1 == 0.0
    sinks.write_csv(reports.records(art), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_backend(spark):
    def model(requests):
        if any(r["t"] == "bad" for r in requests):
            raise RuntimeError("down")
        return [f'so: {{"profile": "{r["t"]}"}}' if r["t"] != "none" else None for r in requests]

    df = spark.createDataFrame([("x",), ("none",)], "t string").coalesce(1)
    got = backend.ask(df, model, ["t"]).select("t", backend.prefer(F.col("response"), "profile string", "profile", F.lit("h")).alias("p")).collect()
    assert {r.t: r.p for r in got} == {"x": "x", "none": "h"}


def _counted(log, poison):
    """A backend that writes down what it is asked and fails with one text."""

    def model(requests):
        with open(log, "a") as out:
            out.writelines(r["t"] + "\n" for r in requests)
        if any(r["t"] == poison for r in requests):
            raise RuntimeError("down")
        return ["so " + r["t"] for r in requests]

    return model


def test_one_bad_request_stands_alone_and_none_is_made_twice(spark, tmp_path):
    log, ledger = tmp_path / "log", str(tmp_path / "ledger")
    df = spark.createDataFrame([(i, f"t{i % 700}", None) for i in range(1000)], "id int, t string, u string")
    for _ in range(2):
        got = {r.id: (r.response, r.response_error) for r in backend.ask(df, _counted(str(log), "t5"), ["t", "u"], ledger=ledger).collect()}
        assert len(got) == 1000
        assert {i for i, (response, _) in got.items() if response is None} == {5, 705} and got[5] == (None, "down") and got[6] == ("so t6", None)
        asked = log.read_text().split()
        assert len(set(asked)) == 700 and len(asked) <= 700 + 40  # only the halves of one call are made again
    more = df.unionByName(spark.createDataFrame([(2000, "new", None)], df.schema))
    backend.ask(more, _counted(str(log), "t5"), ["t", "u"], ledger=ledger).count()
    assert log.read_text().split()[len(asked) :] == ["new"]
    assert backend.ask(df.limit(0), _counted(str(log), ""), ["t"]).count() == 0


def test_calls_have_a_deadline_and_a_bound():
    import threading
    import time

    def slow(requests):
        if requests[0]["t"] == "hang" or len(requests) > 1:
            time.sleep(5)
        return ["ok"] * len(requests)

    began = time.monotonic()
    assert backend.answered(slow, [{"t": "x"}, {"t": "hang"}], 0.3, began + 60) == [("ok", None), (None, "no answer within 0.3 seconds")]
    assert backend.answered(slow, [{"t": "x"}] * 4, 0.3, began) == [(None, "deadline exceeded")] * 4
    assert time.monotonic() - began < 4
    short = backend.answered(lambda r: [], [{"t": "x"}], 1, time.monotonic() + 9)
    assert short == [(None, "0 answers to 1 requests")]

    def gone(requests):
        raise backend.Unrecoverable("no such document")

    assert backend.answered(gone, [{}], 1, time.monotonic() + 9) == [(None, "unrecoverable: no such document")]
    assert threading.active_count() < 50


def test_a_failed_example_counts_alone(spark, source):
    given = examples.load_examples(source)
    lost = given.select("example_id").orderBy("example_id").first().example_id

    def model(requests):
        if any(r["example_id"] == lost and r["task"] == "extraction" for r in requests):
            raise backend.Unrecoverable("lost")
        return [None] * len(requests)

    rows = experiment.run(given, backend=model, tasks=("extraction",)).where("baseline LIKE 'graph%'").collect()
    wrong = [r for r in rows if r.example_id == lost]
    assert wrong and all((r.error, r.confidence, r.extraction_f1, r.support_score, r.answer_generation_mode) == ("lost", 0.08, 0.0, 0.0, "runtime_error_fallback") for r in wrong)
    assert all(r.quality_notes == ["Runtime exception fallback: lost"] for r in wrong)
    assert all(r.error is None and r.answer_generation_mode != "runtime_error_fallback" for r in rows if r.example_id != lost)


def test_streams(spark, tmp_path):
    rows = [(1, "a", 0, 1.0), (2, "a", 10, 3.0), (3, "a", 2000, 5.0), (4, "b", 5, 7.0)]
    events = spark.createDataFrame(rows, "id int, k string, s long, v double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = progress.watch(spark, str(tmp_path / "in"), "id int, k string, v double, ts timestamp")
    got = {r.k: (r.n, r["mean"]) for r in progress.collected(progress.snapshots(stream, "k", "v"), "complete", str(tmp_path / "c1")).collect()}
    assert got == {"a": (3, 3.0), "b": (1, 7.0)}
    seen = []
    done = stream.withColumns({"status": F.when(F.col("id") >= 2, "completed"), "run_id": F.col("k")})
    for more in range(2):  # the same runs complete again
        events.withColumn("id", F.col("id") + 10 * more).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        progress.on_completion(done, str(tmp_path / "c3"), lambda batch, number: seen.extend(r.run_id for r in batch.collect())).awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_checkpoints(spark, tmp_path):
    text = json.dumps({"run_id": "r", "status": "running", "stage": "s", "sample_count": 4, "baseline_progress": {"b": {"progress": {"status": "running", "processed_examples": 2, "total_examples": 4}, "metrics": {"answer_quality_score": 0.5}}}})
    df = spark.createDataFrame([(text,)], "value string")
    shot = progress.checkpoint_snapshots(df).first()
    assert shot.run_id == "r" and shot.baseline_progress["b"].processed_examples == 2 and shot.baseline_progress["b"].answer_quality_score == 0.5
    row = progress.baseline_progress(df).first()
    assert (row.baseline, row.status, row.total_examples) == ("b", "running", 4)
    path = runs.write_checkpoint(tmp_path, "r", {"x": {"metrics": {"answer_quality_score": 0.1}, "processed_examples": 1, "total_examples": 2}, "reference_only_baseline": {"metrics": {"answer_quality_score": 9.0}}}, {"reference_only_baseline": {"metrics": {"answer_quality_score": 0.4}}}, sample_count=2)
    found = runs.checkpoint(tmp_path, "r")
    assert found["_source_kind"] == "checkpoint" and found["baseline_progress"]["reference_only_baseline"]["progress"]["status"] == "completed"
    assert found["available_answer_quality_delta_matrix"]["x"]["reference_only_baseline"] == -0.3 and [r["baseline"] for r in found["available_comparison_table"]] == ["reference_only_baseline"]
    assert any(line.startswith("  x: running 1/2") for line in runs.status_lines(found))
    path.rename(path.with_name("r_summary.json"))
    assert runs.checkpoint(tmp_path, "r")["_source_kind"] == "summary" and runs.summary(tmp_path, "r")["run_id"] == "r"
    assert json.loads(runs.write_failure(tmp_path, "r", ValueError("no")).read_text())["error"] == "ValueError: no"
    with pytest.raises(FileNotFoundError):
        runs.checkpoint(tmp_path, "other")


def test_paths_orders_and_tables(tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
    assert runs.baseline_order(None, tmp_path) == ["a", "b"] and runs.baseline_order({"auxiliary_baseline_order": ["z"], "ontology_baseline_order": ["y"]}, tmp_path) == ["z", "y"]
    assert runs.chosen_baselines(["b", "a"]) == ["a", "b"] and runs.chosen_baselines(["b", "a"], ["c", "b"]) == ["b"]
    assert runs.file_slug("Shareholder Return/x") == "shareholder_return_x" and runs.dashed("Run_1: a/b") == "run-1--a-b"
    assert runs.artifact_root(tmp_path, "r").parts[-2:] == ("artifacts", "r") and runs.artifact_root(tmp_path, None, str(tmp_path)) == tmp_path.resolve()
    with pytest.raises(ValueError):
        runs.artifact_root(tmp_path, None)
    assert runs.manual_evaluation(tmp_path, "r") is None
    table = runs.markdown_table([{"a": 1, "b": 0.5}, {"a": None, "b": "x"}], ["a", "b"])
    assert table.splitlines() == ["| a | b |", "| --- | --- |", "| 1 | 0.500 |", "| - | x |"]
    assert "## b1" in runs.markdown_snapshot({"run_id": "r"}, [{"baseline": "b1", "n": 1}], [{"baseline": "b1", "category": "c", "n": 1}])


def test_run_tables(spark, tmp_path):
    sinks.create(spark, str(tmp_path))
    with pytest.raises(LookupError):
        exports.load_run(spark, str(tmp_path), "r")
    sinks.upsert(spark.createDataFrame([("r", "running")], "run_id string, status string"), str(tmp_path), "experiment_runs", 1)
    sinks.upsert(spark.createDataFrame([("r", "completed")], "run_id string, status string"), str(tmp_path), "experiment_runs", 2)
    assert exports.load_run(spark, str(tmp_path), "r")["status"] == "completed"
    rows = [("007", "b", "d2"), ("007", "a", "d1"), ("8", "a", "d1")]
    sinks.upsert(spark.createDataFrame(rows, "run_id string, baseline string, doc_id string"), str(tmp_path), "graph_ingestion", 1)
    found = exports.load(spark, str(tmp_path), "graph_ingestion", "007")
    assert [(r.run_id, r.doc_id) for r in found.collect()] == [("007", "d1"), ("007", "d2")]
    assert "PartitionFilters: [isnotnull(run_id" in found._jdf.queryExecution().toString()
    nodes = spark.createDataFrame([("g", "a", 1), ("g", "b", 1)], "graph_id string, node_id string, v int")
    edges = spark.createDataFrame([("g", "1", "a", "b"), ("g", "2", "a", "gone")], "graph_id string, edge_id string, source_node_id string, target_node_id string")
    sinks.write_graph(nodes, edges, str(tmp_path / "graph"), 1)
    sinks.write_graph(nodes.where("node_id = 'b'").withColumn("v", F.lit(2)), edges.limit(0), str(tmp_path / "graph"), 2)
    n, e = sinks.read_graph(spark, str(tmp_path / "graph"))
    assert {(r.node_id, r.v) for r in n.collect()} == {("a", 1), ("b", 2)} and [r.edge_id for r in e.collect()] == ["1"]
    sinks.append_log(nodes, str(tmp_path / "log"))
    sinks.append_log(nodes, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    sinks.write_artifacts(spark.createDataFrame([("b", "e", [1])], "baseline string, example_id string, x array<int>"), str(tmp_path / "art"))
    assert spark.read.json(str(tmp_path / "art")).first().baseline == "b"
    sinks.write_summary({"n": 1}, str(tmp_path / "s.json"))
    assert runs.read_json(tmp_path / "s.json") == {"n": 1}

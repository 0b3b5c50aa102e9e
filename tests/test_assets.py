"""The tables that are made of a report: intervals as text, in the baselines' order, as CSV and Markdown."""

import csv

from factloom.plans import exports
from factloom.sources import runs


def test_table_of_a_report(spark, tmp_path):
    full, free = "full_minimal_pipeline_with_quality_aware_evidence_selection", "graph_without_ontology_constraints"
    rows = [(full, "overall", "answer_quality_score", 0.5, 0.25, 0.75), (free, "overall", "answer_quality_score", 0.125, None, None), (free, "Financials", "answer_quality_score", 0.9, None, None), (full, "overall", "fallback_error_rate", None, None, None)]
    report = spark.createDataFrame(rows, "baseline string, category string, metric string, mean double, ci_low double, ci_high double")
    wide = exports.wide_table(exports.report_lookup([report]))
    columns = {"baseline": "Baseline", "answer_quality_score": "Answers", "answer_quality_delta": "Against the free graph", "fallback_error_rate": "Fell back"}
    table, page = runs.write_table([r.asDict() for r in wide.collect()], columns, tmp_path / "assets", "results", "Results", ["A note."])
    found = list(csv.DictReader(table.open()))
    assert list(found[0]) == list(columns) and [r["baseline"] for r in found][0] == free and [r["baseline"] for r in found][-1] == full
    assert (found[-1]["answer_quality_score"], found[-1]["answer_quality_delta"], found[-1]["fallback_error_rate"]) == ("0.500 [0.250, 0.750]", "0.375", "-")
    assert found[1]["answer_quality_score"] == "-" and found[0]["answer_quality_score"] == "0.125"
    lines = page.read_text().splitlines()
    assert lines[0] == "# Results" and lines[2].startswith("| Baseline | Answers |") and lines[-1] == "- A note."
    assert runs.write_table([], columns, tmp_path, "none", "None")[0].read_text().strip() == ",".join(columns)

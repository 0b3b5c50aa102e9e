"""A run's folders and small files, on the driver: checkpoints, summaries, failures, status, Markdown."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from factloom.plans import dims

RUNS = "data/experiment_runs"
MANUAL = "exports/manual_gold"


def file_slug(name: str) -> str:
    """A category as a file's name."""
    return name.lower().replace(" ", "_").replace("/", "_")


def dashed(text: str) -> str:
    return "".join("-" if c in " /:_" else c for c in text.lower())


def artifact_root(root: str | Path, run_id: str | None, override: str | None = None) -> Path:
    """The folder given, else the run's own."""
    if override:
        return Path(override).resolve()
    if not run_id:
        raise ValueError("either a run id or a folder of artifacts is needed")
    return (Path(root) / RUNS / "artifacts" / run_id).resolve()


def manual_evaluation(root: str | Path, run_id: str, file: str | None = None, of_run: str | None = None) -> Path | None:
    """The file given, else that of another run if there is one, else the run's own; None without any."""
    if file:
        return Path(file).resolve()
    candidates = (Path(root) / MANUAL / f"{name}_manual_gold_eval.json" for name in (of_run, run_id) if name)
    return next((c for c in candidates if c.is_file()), None)


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text())


def summary(root: str | Path, run_id: str, notes: str | None = None) -> dict | None:
    """The summary that the run's notes name, else the run's own file, else None."""
    for path in (Path(notes) if notes else None, Path(root) / RUNS / f"{run_id}_summary.json"):
        if path is not None and path.is_file():
            return read_json(path)
    return None


def checkpoint(root: str | Path, run_id: str) -> dict:
    """The run's checkpoint, or its summary, with where it comes from."""
    for kind in ("checkpoint", "summary"):
        path = Path(root) / RUNS / f"{run_id}_{kind}.json"
        if path.is_file():
            return {**read_json(path), "_source_path": str(path), "_source_kind": kind}
    raise FileNotFoundError(f"no checkpoint or summary of {run_id}")


def baseline_order(found: Mapping | None, folder: str | Path) -> list[str]:
    """The order that a summary names, else the artifacts' folders in order of name."""
    ordered = [*(found or {}).get("auxiliary_baseline_order", []), *(found or {}).get("ontology_baseline_order", [])]
    return ordered or sorted(p.name for p in Path(folder).iterdir() if p.is_dir())


def chosen_baselines(available: Iterable[str], include: Sequence[str] = ()) -> list[str]:
    """The baselines asked for that there are, as asked; all of them, in order, if none is asked for."""
    there = sorted(available)
    return [name for name in include if name in there] if include else there


def _write(path: Path, payload: Mapping) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_suffix(".tmp")
    temporary.write_text(json.dumps(payload, indent=2, default=str))
    temporary.replace(path)
    return path


def write_checkpoint(root: str | Path, run_id: str, running: Mapping[str, Mapping], completed: Mapping[str, Mapping], **state: Any) -> Path:
    """The state of a run: baselines that run, overridden by those that are done, and a table of their metrics."""
    total = state.get("sample_count")
    of = lambda b, status, n, m: {"metrics": dict(b["metrics"]), "progress": {"status": status, "processed_examples": n, "total_examples": m}, "global_quality_issue_counts": b.get("global_quality_issue_counts", {})}
    both = {name: of(b, b.get("status", "running"), b.get("processed_examples"), b.get("total_examples")) for name, b in running.items()}
    both |= {name: of(b, "completed", total, total) for name, b in completed.items()}
    scores = {name: b["metrics"].get("answer_quality_score") for name, b in both.items()}
    delta = lambda a, b: None if a is None or b is None else round(a - b, 3)
    payload = {
        "run_id": run_id, "status": "running", "stage": None, "current_baseline": None, "sample_count": None, "started_at": None, "finished_at": None, "error": None,
        "prefetch_progress": {}, "completed_baselines": list(completed), **state, "updated_at": datetime.now(timezone.utc).isoformat(), "baseline_progress": both,
        "available_comparison_table": [{"baseline": name, **both[name]["metrics"]} for name in dims.BASELINES if name in both],
        "available_answer_quality_delta_matrix": {a: {b: delta(x, y) for b, y in scores.items()} for a, x in scores.items()},
    }
    return _write(Path(root) / RUNS / f"{run_id}_checkpoint.json", payload)


def write_failure(root: str | Path, run_id: str, error: BaseException, **state: Any) -> Path:
    """What is known of a run that failed."""
    payload = {"run_id": run_id, "status": "failed", "error": f"{type(error).__name__}: {error}", "failed_at": datetime.now(timezone.utc).isoformat(), **state}
    return _write(Path(root) / RUNS / f"{run_id}_failure.json", payload)


def status_lines(payload: Mapping) -> list[str]:
    """A run's state as lines for a console."""
    lines = [f"{name}: {payload.get(name)}" for name in ("run_id", "status", "stage", "current_baseline", "sample_count")]
    for name, b in sorted(payload.get("baseline_progress", {}).items()):
        progress, found = b.get("progress", {}), b.get("metrics", {})
        lines.append(f"  {name}: {progress.get('status')} {progress.get('processed_examples')}/{progress.get('total_examples')} answer={found.get('answer_quality_score')} coverage={found.get('query_support_path_coverage')}")
    for row in payload.get("available_comparison_table") or payload.get("comparison_table") or []:
        lines.append("  " + ", ".join(f"{k}={v}" for k, v in row.items()))
    return lines


def markdown_table(rows: Sequence[Mapping], columns: Sequence[str]) -> str:
    """A small table of collected rows; null reads ``-``."""
    shown = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(shown(row.get(c)) for c in columns) + " |" for row in rows)])


def write_table(rows: Iterable[Mapping], columns: Mapping[str, str], folder: str | Path, name: str, title: str, notes: Sequence[str] = ()) -> tuple[Path, Path]:
    """A report's table (a row a baseline) as CSV, headed by column names, and as Markdown, headed by their titles, with notes below."""
    rows, folder = list(rows), Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    known = list(dims.BASELINES)
    rows.sort(key=lambda r: known.index(r["baseline"]) if r["baseline"] in known else len(known))
    with (folder / f"{name}.csv").open("w", newline="") as out:
        writer = csv.DictWriter(out, list(columns), extrasaction="ignore")
        writer.writeheader()
        writer.writerows(rows)
    table = markdown_table([{columns[c]: row.get(c) for c in columns} for row in rows], list(columns.values()))
    parts = [f"# {title}", table, *(["\n".join(f"- {n}" for n in notes)] if notes else [])]
    (folder / f"{name}.md").write_text("\n\n".join(parts) + "\n")
    return folder / f"{name}.csv", folder / f"{name}.md"


def markdown_snapshot(state: Mapping, overall: Sequence[Mapping], by_category: Sequence[Mapping]) -> str:
    """A snapshot of a run: its state, a table of baselines and one a baseline by category."""
    parts = ["# Run snapshot", "\n".join(f"- {name}: `{state.get(name)}`" for name in ("run_id", "status", "stage", "current_baseline", "sample_count", "updated_at"))]
    parts += ["## Overall", markdown_table(overall, list(overall[0]) if overall else [])]
    for name in dict.fromkeys(row["baseline"] for row in by_category):
        rows = [{k: v for k, v in row.items() if k != "baseline"} for row in by_category if row["baseline"] == name]
        parts += [f"## {name}", markdown_table(rows, list(rows[0]))]
    return "\n\n".join(parts) + "\n"

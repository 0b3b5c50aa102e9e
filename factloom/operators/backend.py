"""Optional model backend behind the heuristics.

A backend is a function from a list of request dicts to a list of JSON strings (or None).  Its answers
come back as a column; ``prefer`` takes them where they parse and the heuristic elsewhere.
"""

from __future__ import annotations

import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import lenient_json
from factloom.operators.extract import from_model
from factloom.plans import dims
from factloom.sources.staging import folder, staged

Backend = Callable[[list[dict]], list[str | None]]
#: A request's row of a ledger: what was answered, or why nothing was.
LEDGER = "request_key string, response string, error string"
#: Begins the reason of a request that the backend gave up for good.
FATAL = "unrecoverable: "


class Unrecoverable(Exception):
    """Raised by a backend for a request that must not fall back to heuristics: its row counts as failed."""


def _within(seconds: float, backend: Backend, rows: list[dict]) -> list[str | None]:
    """The backend's answers, or an error if they do not come in time; a call that hangs is left behind."""
    found: queue.Queue = queue.Queue()

    def call() -> None:
        try:
            found.put((backend(rows), None))
        except Exception as error:  # handed to the caller
            found.put((None, error))

    threading.Thread(target=call, daemon=True).start()
    try:
        answers, error = found.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds:g} seconds") from None
    if error is not None:
        raise error
    if len(answers) != len(rows):
        raise ValueError(f"{len(answers)} answers to {len(rows)} requests")
    return answers


def answered(backend: Backend, rows: list[dict], timeout: float, until: float) -> list[tuple[str | None, str | None]]:
    """(answer, reason for none) of each request; a call that fails is halved until the bad request stands alone."""
    if time.monotonic() > until:
        return [(None, "deadline exceeded")] * len(rows)
    try:
        return [(a, None if a is not None else "no answer") for a in _within(timeout, backend, rows)]
    except Exception as error:  # the reason is kept with the row
        if len(rows) == 1:
            return [(None, f"{FATAL if isinstance(error, Unrecoverable) else ''}{error}")]
    middle = len(rows) // 2
    return answered(backend, rows[:middle], timeout, until) + answered(backend, rows[middle:], timeout, until)


def ask(df: DataFrame, backend: Backend, columns: Sequence[str], name: str = "response", ledger: str | None = None, workers: int = 4, timeout: float = 90.0, call_rows: int = 16) -> DataFrame:
    """``df`` with the backend's answer to the given columns in ``name``, and the reason for none in ``<name>_error``.

    Equal requests are made once.  Each task keeps ``workers`` calls of ``call_rows`` requests going, each
    of which may take ``timeout`` seconds (ten times that with all halvings); the next calls are made
    while earlier ones run.  Answers and failures go to the table in folder ``ledger`` (one of this
    session if None); what it holds is not asked again, so a run that broke off is taken up there.
    """
    spark = df.sparkSession
    key = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    held = staged(df.withColumn("_request", key), "asking")
    wanted = held.select(F.col("_request").alias("request_key"), *columns).dropDuplicates(["request_key"])
    path = ledger or folder(spark, "ledger")
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    known = spark.read.schema(LEDGER).parquet(path).select("request_key")
    todo = wanted.join(known, "request_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        going: deque = deque()

        def done() -> pd.DataFrame:
            keys, call = going.popleft()
            found = call.result()
            return pd.DataFrame({"request_key": keys, "response": [a for a, _ in found], "error": [e for _, e in found]})

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                for at in range(0, len(batch), call_rows):
                    some = batch.iloc[at : at + call_rows]
                    rows = some[list(columns)].to_dict("records")
                    # Two rounds of calls are handed out ahead, no more.
                    while len(going) >= 2 * workers:
                        yield done()
                    going.append((some["request_key"].tolist(), pool.submit(lambda r: answered(backend, r, timeout, time.monotonic() + 10 * timeout), rows)))
            while going:
                yield done()

    todo.mapInPandas(run, LEDGER).write.mode("append").parquet(path)
    # Two runs at once may both have asked; of equal keys an answer counts before a failure.
    answers = spark.read.schema(LEDGER).parquet(path).groupBy("request_key").agg(F.min(F.struct(F.col("response").isNull().alias("none"), "response", "error")).alias("a"))
    answers = answers.select(F.col("request_key").alias("_key"), F.col("a.response").alias(name), F.when(F.col("a.none"), F.col("a.error")).alias(f"{name}_error"))
    return held.join(answers, F.col("_request") == F.col("_key"), "left").drop("_request", "_key")


#: What a model is told, by task; the names of keys are fixed values.
INSTRUCTIONS = {
    "profile": "Read the document and decide which of the allowed profiles describes it best. Reply with one JSON object: selected_profile (one of the allowed names), confidence (0 to 1) and rationale (a sentence).",
    "extraction": "List what the document states, in the allowed types only. Reply with one JSON object of two lists: entities, whose members have name and entity_type, and relations, whose members have source_name, relation_type and target_name.",
    "answer": "Give a short answer that follows from the context alone; what you know otherwise does not count. Where the context says too little, say what it supports and what is lacking. Reply with one JSON object: answer, confidence (0 to 1) and quality_notes (a list).",
}
TEMPERATURE = 0.0


def prompt(task: str, profile: Column | None = None) -> Column:
    """The request of a task as JSON, from the columns of an example (and, for answers, of its question and context)."""
    if task == "profile":
        return F.to_json(F.struct(F.col("source_text").alias("document_text"), F.array(*map(F.lit, dims.PROFILES)).alias("allowed_profiles")))
    if task == "extraction":
        of = lambda table: F.create_map(*(x for name, kinds in table.items() for x in (F.lit(name), F.array(*map(F.lit, kinds)))))[profile]
        return F.to_json(F.struct(profile.alias("profile"), of(dims.ENTITY_TYPES).alias("allowed_entity_types"), of(dims.PROFILES).alias("allowed_relation_types"), F.col("source_text").alias("document_text")))
    policy = F.struct(*(F.lit(True).alias(name) for name in ("use_only_provided_context", "same_prompt_across_baselines", "be_conservative_when_evidence_is_missing")))
    fields = ["target_profile", "intent_id", "focus_slots", "required_relations", "required_entity_types"]
    return F.to_json(F.struct(F.col("question_text").alias("question"), *fields, policy.alias("answer_policy"), "context_mode", "context_text"))


def requests(df: DataFrame, task: str, profile: Column | None = None) -> DataFrame:
    """``df`` with the columns task, instructions, prompt and temperature that a backend gets."""
    return df.withColumns({"task": F.lit(task), "instructions": F.lit(INSTRUCTIONS[task]), "prompt": prompt(task, profile), "temperature": F.lit(TEMPERATURE)})


def failure(response: str) -> Column:
    """Why a request was given up for good, or null."""
    reason = F.col(f"{response}_error")
    return F.when(F.startswith(reason, F.lit(FATAL)), F.substring(reason, len(FATAL) + 1, 1 << 20))


def choose_profile(df: DataFrame, response: str) -> DataFrame:
    """The model's profile, confidence and reason where it names a known profile, else the row's own, with the failure as reason."""
    parsed = lenient_json(F.col(response), "selected_profile string, confidence string, rationale string")
    good = F.coalesce(parsed["selected_profile"].isin(*dims.PROFILES), F.lit(False))
    failed = F.concat(F.lit("Heuristic fallback used after model profile selection failure: "), F.coalesce(F.col(f"{response}_error"), F.lit("missing worker result")))
    return df.withColumns(
        {
            "selected_profile": F.when(good, parsed["selected_profile"]).otherwise(F.col("selected_profile")),
            "selection_confidence": F.when(good, F.coalesce(parsed["confidence"].try_cast("double"), F.lit(0.7))).otherwise(F.col("selection_confidence")),
            "ontology_rationale": F.when(good, F.coalesce(parsed["rationale"], F.lit(""))).otherwise(failed),
        }
    )


def choose_extraction(df: DataFrame, response: str) -> DataFrame:
    """The model's entities and relations where they can be read, else the row's own; ``extraction_mode`` says which."""
    entities, relations = from_model(F.col(response))
    return df.withColumns({"entities": F.coalesce(entities, F.col("entities")), "relations": F.coalesce(relations, F.col("relations")), "extraction_mode": F.when(entities.isNotNull(), "openai").otherwise("heuristic_fallback")})


def prefer(response: Column, schema: str, field: str, heuristic: Column) -> Column:
    """A field of the parsed answer, or the heuristic."""
    return F.coalesce(lenient_json(response, schema)[field], heuristic)

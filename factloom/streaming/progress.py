"""Progress of runs as streams: snapshots, counts by window, completion steps.

Run metadata arrives as files; each micro-batch is one look at it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", names: str = "*") -> DataFrame:
    """New files of a folder, those with matching names, as a stream."""
    return spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", names).load(folder)


def snapshots(events: DataFrame, key: str, value: str) -> DataFrame:
    """Running count and mean of each key over what has arrived."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def windowed(events: DataFrame, ts: str, key: str, width: str, delay: str) -> DataFrame:
    """Counts by key and time window; rows later than ``delay`` are dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return timed.groupBy(F.window("_ts", width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def on_completion(stream: DataFrame, checkpoint: str, done: Callable[[DataFrame, int], None], run: str = "run_id") -> StreamingQuery:
    """Run ``done`` once for each completed run, however often its row comes; a repeated batch has the same number."""
    finished = stream.where("status = 'completed'").dropDuplicates([run])

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            done(batch, number)

    return finished.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


# The fields of a checkpoint.
CHECKPOINT = (
    "run_id string, status string, stage string, current_baseline string, sample_count long, updated_at string, "
    "baseline_progress map<string, struct<progress: struct<status: string, processed_examples: long, total_examples: long>, "
    "metrics: struct<profile_selection_accuracy: double, ontology_constrained_extraction_f1: double, query_support_path_coverage: double, answer_quality_score: double, answer_quality_delta: double>>>"
)


def checkpoint_snapshots(checkpoints: DataFrame, json: str = "value") -> DataFrame:
    """What a look at a checkpoint shows: its state and each baseline's progress and scores, from its JSON text."""
    df = checkpoints.select(F.from_json(json, CHECKPOINT).alias("c")).select("c.*")
    shown = lambda _, b: F.struct(
        b["progress"]["processed_examples"].alias("processed_examples"), b["progress"]["total_examples"].alias("total_examples"),
        b["metrics"]["answer_quality_score"].alias("answer_quality_score"), b["metrics"]["ontology_constrained_extraction_f1"].alias("ontology_constrained_extraction_f1"), b["metrics"]["query_support_path_coverage"].alias("query_support_path_coverage"),
    )
    return df.select("run_id", "status", "stage", "current_baseline", "sample_count", F.transform_values("baseline_progress", shown).alias("baseline_progress"))


def baseline_progress(checkpoints: DataFrame, json: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """(keep, run_id, baseline, status, processed_examples, total_examples, metrics...) of checkpoints' JSON text, a row a baseline."""
    df = checkpoints.select(*keep, F.from_json(json, CHECKPOINT).alias("c")).select(*keep, "c.run_id", F.explode("c.baseline_progress").alias("baseline", "b"))
    return df.select(*keep, "run_id", "baseline", "b.progress.*", "b.metrics.*")


def collected(stream: DataFrame, mode: str, path: str) -> DataFrame:
    """All that a stream gives over the files there are: its batches under ``path``, by number, read back.

    A repeated batch replaces itself; of a ``complete`` stream the last batch is the result.
    """
    numbers: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        numbers.append(number)

    stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    kept = numbers[-1:] if mode == "complete" else numbers
    if not kept:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{path}/out/batch={n}" for n in kept))

"""Streams: rewritten files, silences by timers, partial means that are written once."""

import json

from pyspark.sql import functions as F

from factloom.sources import files, runs
from factloom.streaming import partial, progress, rewritten, silence


def looks(spark, folder, at):
    """One look of the stream at a folder, appended to what earlier looks have seen."""
    stream = progress.baseline_progress(rewritten.watch(spark, str(folder), f"{at}/spool", "*_checkpoint.json"), keep=["version"])
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.version, r.run_id, r.processed_examples) for r in spark.read.parquet(f"{at}/out").collect())


def test_a_rewritten_file_is_seen_each_time(spark, tmp_path):
    write = lambda run, n: runs.write_checkpoint(tmp_path, run, {"x": {"metrics": {}, "processed_examples": n, "total_examples": 9}}, {})
    folder, at = write("r", 1).parent, tmp_path / "watch"
    assert looks(spark, folder, at) == [(1, "r", 1)]
    assert looks(spark, folder, at) == [(1, "r", 1)]  # nothing new
    write("r", 2)
    assert looks(spark, folder, at) == [(1, "r", 1), (2, "r", 2)]
    write("r", 3)
    write("s", 7)
    (folder / "other.json").write_text("{}")
    seen = looks(spark, folder, at)
    assert [s[1:] for s in seen] == [("r", 1), ("r", 2), ("r", 3), ("s", 7)]


def test_a_batch_is_read_again_as_it_was(tmp_path):
    """A planned batch survives the file's rewriting and the reader's end."""
    file, spool = tmp_path / "in" / "a.json", str(tmp_path / "spool")
    file.parent.mkdir()
    file.write_text("first")
    reader = lambda: rewritten._Reader(str(file.parent), "*.json", spool)
    read = lambda start, end: [row[4] for p in reader().partitions(start, end) for row in reader().read(p)]
    start, end = reader().initialOffset(), reader().latestOffset()
    file.write_text("second!")
    later = reader().latestOffset()
    assert read(start, end) == ["first"] and read(end, later) == ["second!"] and read(start, later) == ["first", "second!"]
    reader().commit(end)
    assert read(end, later) == ["second!"] and len(files.listed(spool, "[0-9]*")) == 1
    assert reader().latestOffset() == later


def arrive(spark, folder, rows):
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.mode("append").parquet(str(folder))


def told(spark, folder, at, delay="0 seconds", forget=None):
    stream = silence.silences(progress.watch(spark, str(folder), "k string, ts timestamp"), "k", "ts", 100, delay, forget)
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = [(r.k, r.last_seen, r.silence, r.returned) for r in spark.read.parquet(f"{at}/out").collect()]
    return sorted(rows, key=lambda r: (r[0], r[1], r[3]))


def test_silences_over_batches(spark, tmp_path):
    folder, at = tmp_path / "in", tmp_path / "s"
    arrive(spark, folder, [("a", 1_000), ("a", 1_050), ("b", 1_000), (None, 1_000), ("hot", 1_000)] + [("hot", 1_000 + i) for i in range(200)])
    first = told(spark, folder, at)
    assert first == [("a", 1_050, None, False), ("b", 1_000, None, False)]  # the watermark is at 1,199
    # a returns; b's row is too late to count; hot goes on, out of order.
    arrive(spark, folder, [("a", 1_400), ("a", 1_390), ("b", 1_100), ("hot", 1_250)])
    second = told(spark, folder, at)
    assert set(first) < set(second) and ("a", 1_050, 340, True) in second
    assert [r for r in second if r[0] == "b"] == [("b", 1_000, None, False)]
    assert [r for r in second if r[0] == "hot"] == [("hot", 1_250, None, False)]
    arrive(spark, folder, [("c", 9_000), ("b", 8_000)])
    third = told(spark, folder, at)
    # b had not been seen for longer than it is remembered (3,000 seconds).
    assert [r for r in third if r[0] == "b"] == [("b", 1_000, None, False), ("b", 8_000, None, False)]
    assert [r for r in third if r[0] == "a"] == [("a", 1_050, None, False), ("a", 1_050, 340, True), ("a", 1_400, None, False)]
    assert told(spark, folder, at) == third


def test_spans_merge_in_any_order():
    rows = [(5, 5), (1, 1), (30, 40), (12, 12), (41, 60), (3, 9)]
    assert silence.merged(rows, 3) == [(1, 12), (30, 60)] == silence.merged(list(reversed(rows)), 3)


def test_partial_means_are_written_once(spark, tmp_path):
    batch = lambda rows: spark.createDataFrame(rows, "b string, x double, y double")
    folder, seen = str(tmp_path / "means"), lambda: {r.b: (r.processed, r.x, r.y) for r in partial.means(spark, folder, ["b"], ["x", "y"]).collect()}
    assert partial.means(spark, folder, ["b"], ["x"]) is None
    assert partial.apply(batch([("p", 1.0, None), ("q", 2.0, 4.0)]), 0, folder, ["b"], ["x", "y"])
    assert seen() == {"p": (1, 1.0, None), "q": (1, 2.0, 4.0)}
    # A repeated batch changes nothing; nor does one that a crash has cut short before it is repeated.
    assert not partial.apply(batch([("p", 9.0, 9.0)]), 0, folder, ["b"], ["x", "y"])
    batch([("p", 500.0, 500.0)]).selectExpr("b", "1L AS processed", "x AS sum_x", "y AS sum_y", "1L AS n_x", "1L AS n_y").write.parquet(f"{folder}/batch=1")
    (tmp_path / "means" / "batch=1" / "_SUCCESS").unlink()
    assert partial.apply(batch([("p", 3.0, 5.0)]), 1, folder, ["b"], ["x", "y"])
    assert seen() == {"p": (2, 2.0, 5.0), "q": (1, 2.0, 4.0)}
    assert partial.apply(batch([("r", 1.0, 1.0)]), 2, folder, ["b"], ["x", "y"]) and partial.versions(spark, folder) == [1, 2]


def test_partial_means_of_a_stream_are_taken_up(spark, tmp_path):
    arrivals, at, shown = str(tmp_path / "in"), str(tmp_path / "c"), []
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(id % 2 AS string) AS b", "cast(id AS double) AS x")
    publish = lambda n, means: shown.append((n, {r.b: (r.processed, r.x) for r in means.collect()}))
    go = lambda: partial.write(spark.readStream.schema("b string, x double").option("maxFilesPerTrigger", 1).parquet(arrivals), at, ["b"], ["x"], publish).awaitTermination()
    rows(0, 10).repartition(2).write.parquet(arrivals)
    go()
    assert shown[-1] == (1, {"0": (5, 4.0), "1": (5, 5.0)})
    rows(10, 20).coalesce(1).write.mode("append").parquet(arrivals)
    go()
    assert shown[-1] == (2, {"0": (10, 9.0), "1": (10, 10.0)})
    # What is shown is a run's checkpoint.
    state = {b: {"metrics": {"answer_quality_score": x}, "processed_examples": n, "total_examples": 20} for b, (n, x) in shown[-1][1].items()}
    held = json.loads(runs.write_checkpoint(tmp_path, "r", state, {}).read_text())
    assert held["baseline_progress"]["1"]["progress"]["processed_examples"] == 10

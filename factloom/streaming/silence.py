"""Alerts on silent keys, by state with event-time timers.

Rows of a key are merged into spans that no silence breaks, first where they arrive, so that a hot key
sends few rows, then in its state, which holds the open spans and the last closed one's end, and no
rows.  Timers on the watermark close a span, report the key's return, and forget it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(spans: list[tuple[int, int]], seconds: int) -> list[tuple[int, int]]:
    """Spans in order, those joined between which no more than ``seconds`` pass."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin - out[-1][1] <= seconds:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


class _Silences(StatefulProcessor):
    def __init__(self, key: str, seconds: int, forget: int):
        self.key, self.seconds, self.forget = key, seconds, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("spans", "last long, begins array<long>, ends array<long>")

    def _held(self) -> tuple[int | None, list[tuple[int, int]]]:
        if not self.state.exists():
            return None, []
        last, begins, ends = self.state.get()
        return last, list(zip(begins, ends, strict=True))

    def _keep(self, last: int | None, spans: list[tuple[int, int]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not spans and last is None:
            self.state.clear()
            return
        self.state.update((last, [b for b, _ in spans], [e for _, e in spans]))
        if not spans:
            at = last + self.forget
        else:
            at = spans[0][0] if last is not None else spans[0][1] + self.seconds
        self.handle.registerTimer(1000 * at)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last, spans = self._held()
        for row in rows:
            spans = merged([*spans, (row.begin, row.end)], self.seconds)
        self._keep(last, spans)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now, out = timerValues.getCurrentWatermarkInMs() // 1000, []
        last, spans = self._held()
        while True:
            if spans and last is not None and spans[0][0] <= now:
                if self.seconds < spans[0][0] - last <= self.forget:
                    out.append((key[0], last, spans[0][0] - last, True))
                last = None
            elif spans and last is None and spans[0][1] + self.seconds <= now:
                last = spans.pop(0)[1]
                if not spans:
                    out.append((key[0], last, None, False))
            elif not spans and last is not None and last + self.forget <= now:
                last = None
            else:
                break
        self._keep(last, spans)
        return iter([Row(**{self.key: k, "last_seen": seen, "silence": silence, "returned": returned}) for k, seen, silence, returned in out])

    def close(self) -> None:
        pass


def silences(events: DataFrame, key: str, ts: str, seconds: int, delay: str, forget: int | None = None) -> DataFrame:
    """(key, last_seen, silence, returned) of keys silent for more than ``seconds``, times in seconds.

    A row with ``returned`` tells a silence that has ended, once, as soon as the watermark has passed its
    end; one without tells that a key has been silent for ``seconds`` by the watermark and nothing newer
    is known.  Rows that come more than ``delay`` late are left out.  A key is forgotten ``forget``
    seconds (30 times ``seconds`` if None) after its last row; a return later than that is not told.  Rows
    without a key or a time are left out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)  # timers need it
    kind = events.schema[key].dataType
    keyed = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").cast("long").alias("t")).where("key IS NOT NULL AND t IS NOT NULL")

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values(["key", "t"])
            new = (batch["key"] != batch["key"].shift()) | (batch["t"].diff() > seconds)
            yield batch.assign(span=new.cumsum()).groupby("span", sort=False).agg(key=("key", "first"), begin=("t", "min"), end=("t", "max"))[["key", "begin", "end"]]

    fields = [T.StructField("key", kind), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]
    joined = keyed.mapInPandas(spans, T.StructType(fields)).withColumn("seen", F.timestamp_seconds("end")).withWatermark("seen", delay)
    out = T.StructType([T.StructField(key, kind), T.StructField("last_seen", T.LongType()), T.StructField("silence", T.LongType()), T.StructField("returned", T.BooleanType())])
    return joined.groupBy("key").transformWithState(_Silences(key, seconds, 30 * seconds if forget is None else forget), out, "Append", "EventTime")

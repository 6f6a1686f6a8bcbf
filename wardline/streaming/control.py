"""Metrics: progress of streaming queries, rates and delays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Watchdog(StreamingQueryListener):
    """Keeps the last progress of each query: input rate, rows kept in state and dropped late, and delay as observed."""

    def __init__(self, report: Callable[[dict], None] | None = None):
        self.report, self.last = report, {}

    def onQueryStarted(self, event) -> None:
        self.last[str(event.id)] = {}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = p.stateOperators[0] if p.stateOperators else None
        seen = {"eps": p.inputRowsPerSecond, "processed_eps": p.processedRowsPerSecond, "batch": p.batchId, "keys": state.numRowsTotal if state else 0, "late": state.numRowsDroppedByWatermark if state else 0}
        self.last[str(p.id)] = seen
        if self.report:
            self.report(seen)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.last.pop(str(event.id), None)


def events_per_second(events: DataFrame, ts: str = "ts") -> DataFrame:
    """(start, n): tumbling counts of one second."""
    return events.groupBy(F.window(ts, "1 second").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def processing_delay(events: DataFrame, now_seconds: int, max_delay: int) -> DataFrame:
    """(late, n, worst): events by whether they waited longer than max_delay (0: never) between receipt and now."""
    delay = F.lit(now_seconds) - F.floor(F.col("rcvd_time") / 1_000_000_000)
    late = (delay > max_delay) if max_delay else F.lit(False)
    return events.select(late.alias("late"), delay.alias("d")).groupBy("late").agg(F.count("*").alias("n"), F.max("d").cast("bigint").alias("worst"))


def queue_report(events: DataFrame, capacity: int, ts: str = "ts") -> DataFrame:
    """(second, received, dropped): what a queue of so many events would have turned away, by second; a report only."""
    by = events.groupBy(F.date_trunc("second", ts).alias("second")).agg(F.count("*").alias("received"))
    return by.withColumn("dropped", F.greatest(F.lit(0), F.col("received") - capacity).cast("bigint"))

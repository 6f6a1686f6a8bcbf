"""Streaming correlation: the same machine as in batch, its backlogs in keyed state with event-time timers.

A micro-batch is unordered, so each key's rows are sorted before they are stepped.  Backlogs expire by their own
key's events first, and by a timer on the watermark where a key has gone quiet.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardline.operators import machine
from wardline.operators.correlate import keyed, records
from wardline.plans.directives import Directive, names_v6
from wardline.schemas import OUTPUT

#: Allowed lateness: no less than the machine's own slack.
WATERMARK = "10 seconds"


def correlate_stream(events: DataFrame, directives: list[Directive], life_minutes: int = 0, watermark: str = WATERMARK, unique_ids: bool = False) -> DataFrame:
    """Alarm events and alarm upserts (schema OUTPUT) of a stream of normalised events with ts, seq and lookups.

    unique_ids: no event id comes twice, so that work can be split by pinned fields; otherwise a directive is one key.
    """
    by_id, life, columns = {d.id: d for d in directives}, life_minutes * 60, OUTPUT.names
    rows = keyed(events, directives, unique_ids, names_v6(directives))
    rows = rows.selectExpr("*", "timestamp_seconds(ts_unix) as ts").withWatermark("ts", watermark)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = by_id[int(key[0])]
        seq, live = (lambda x: (x[0], [machine.Backlog.load(b) for b in json.loads(x[1])]))(state.get) if state.exists else (0, [])
        out: list[dict] = []
        if state.hasTimedOut:
            out += machine.expire(d, live, state.getCurrentWatermarkMs() // 1000, life, seq)
        else:
            for seq, e in records(pd.concat(list(batches), ignore_index=True)):
                out += machine.step(d, live, e, seq, life)
        if live:
            state.update((seq, json.dumps([b.dump() for b in live])))
            due = min(b.start[b.stage - 1] + b.rules[b.stage - 1].timeout for b in live) + life
            state.setTimeoutTimestamp(max(due * 1000 + 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([{c: r.get(c) for c in columns} for r in out], columns=columns)

    return rows.groupBy("directive_id", "key").applyInPandasWithState(run, OUTPUT, "seq bigint, backlogs string", "append", GroupStateTimeout.EventTimeTimeout)


def write_outputs(found: DataFrame, path: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] | None = None):
    """A query that appends alarm events and changes to two tables, batch by batch; ``enrich`` joins lookups to changes.

    Each batch goes to a folder of its own number, so a batch that is repeated replaces what it wrote.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("kind = 'event'").select("alarm_id", "directive_id", "stage", "event_id").write.mode("overwrite").parquet(f"{path}/alarm_events/batch={number}")
        changes = batch.where("kind = 'alarm' and risk > 0").drop("kind", "event_id")
        (enrich(changes) if enrich else changes).write.mode("overwrite").parquet(f"{path}/alarms/batch={number}")
        batch.unpersist()

    return found.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append")


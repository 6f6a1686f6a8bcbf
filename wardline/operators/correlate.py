"""Batch correlation: fan-out, partition by directive and key, and the machine over each key's events in order.

Only the columns that the machine reads cross into Python.  A partition's rows are sorted (Spark spills what does not
fit) and streamed through the machine, so a key of any size needs the memory of its live backlogs only.  A key's events
are one chain of steps and so one task's work; directives that pin no field run as one key, which ``unpinned`` tells.

``clock`` is the largest event time that a directive lets in, so that timeouts of keys that go quiet are seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wardline.operators import machine
from wardline.plans.directives import Directive, correlation_key, fan_out, names_v6, pinned
from wardline.schemas import OUTPUT

FIELDS = "event_id ts_unix plugin_id plugin_sid product category subcategory src_ip dst_ip src_port dst_port custom_data1 custom_data2 custom_data3 custom_label1 custom_label2 custom_label3 src_home dst_home src_value dst_value src_name dst_name".split()


#: What links alone need of an event.
LINK_FIELDS = [f for f in FIELDS if not f.startswith("custom_label") and f not in ("src_value", "dst_value", "src_name", "dst_name")]
LINK = T.StructType([OUTPUT[c] for c in ("alarm_id", "directive_id", "stage", "event_id")])
#: Rows that are Python objects at a time, in and out.
ROWS = 1000


def keyed(events: DataFrame, directives: list[Directive], unique_ids: bool = True, v6: bool = False, fields: list[str] = FIELDS) -> DataFrame:
    """A row for each event and directive, with the key that its backlogs live under."""
    return fan_out(events, directives).select("directive_id", correlation_key(directives, unique_ids, v6).alias("key"), "seq", *fields)


def records(pdf: pd.DataFrame) -> Iterator[tuple[int, dict]]:
    """(seq, event) in order; a missing time stays None and comes last."""
    for r in pdf.sort_values(["ts_unix", "seq"], kind="stable", na_position="last").to_dict("records"):
        r["ts_unix"] = None if pd.isna(r["ts_unix"]) else int(r["ts_unix"])
        yield int(r["seq"]), r


def ids_are_unique(events: DataFrame) -> bool:
    return events.groupBy("event_id").count().where("count > 1").isEmpty()


def _split(events: DataFrame, directives: list[Directive], unique_ids: bool | None, v6: bool | None, fields: list[str]) -> DataFrame:
    v6 = names_v6(directives) if v6 is None else v6
    if unique_ids is None:
        unique_ids = not v6 and any(map(pinned, directives)) and ids_are_unique(events)
    return keyed(events, directives, unique_ids, v6, fields)


def _values(c: pa.Array) -> list:
    """The same as to_pylist, faster where nothing is null."""
    return c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()


def _run(rows: DataFrame, directives: list[Directive], life: int, alarms: bool) -> DataFrame:
    """The machine over the rows of each directive and key in order."""
    by_id, schema = {d.id: d for d in directives}, OUTPUT if alarms else LINK
    order = ["directive_id", "key", F.col("ts_unix").asc_nulls_last(), "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, key, clock, seq, live, d = to_arrow_schema(schema), None, 0, 0, [], None
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b, out = whole.slice(lo, ROWS), []
                for values in zip(*map(_values, b.columns)):
                    e = dict(zip(b.schema.names, values))
                    if (e["directive_id"], e["key"]) != key:
                        if live and alarms:
                            out += machine.expire(d, live, clock, life, seq)
                        key, live = (e["directive_id"], e["key"]), []
                        d = by_id[key[0]]
                    clock, seq = e.get("clock"), e["seq"]
                    out += machine.step(d, live, e, seq, life, alarms)
                for at in range(0, len(out), ROWS):
                    yield pa.RecordBatch.from_pylist(out[at : at + ROWS], to)
        if live and alarms:
            yield pa.RecordBatch.from_pylist(list(machine.expire(d, live, clock, life, seq)), to)

    return rows.repartition("directive_id", "key").sortWithinPartitions(*order).mapInArrow(run, schema)


def correlate(events: DataFrame, directives: list[Directive], life_minutes: int = 0, unique_ids: bool | None = None, v6: bool | None = None) -> DataFrame:
    """Alarm events and alarm upserts (schema OUTPUT) of normalised events with seq, ts_unix and asset lookups.

    Work is split by pinned fields only where that is sound.  unique_ids and v6 (a rule names an IPv6 network) say so; left
    out, ids are counted and the rules read.
    """
    rows = _split(events, directives, unique_ids, v6, FIELDS)
    clock = rows.groupBy("directive_id").agg(F.coalesce(F.max("ts_unix"), F.lit(0)).alias("clock"))
    return _run(rows.join(F.broadcast(clock), "directive_id"), directives, life_minutes * 60, True)  # one row of clock for each directive


def links(events: DataFrame, directives: list[Directive], life_minutes: int = 0, unique_ids: bool | None = None, v6: bool | None = None) -> DataFrame:
    """The same as ``alarm_events`` of ``correlate``, without making alarms: no clock is needed, and fewer columns are moved."""
    return _run(_split(events, directives, unique_ids, v6, LINK_FIELDS), directives, life_minutes * 60, False)


def alarm_events(found: DataFrame) -> DataFrame:
    """Every counted event, whatever the risk."""
    return found.where("kind = 'event'").select("alarm_id", "directive_id", "stage", "event_id")


def alarm_changes(found: DataFrame) -> DataFrame:
    """Upserts in order; those of risk 0 are not published."""
    return found.where("kind = 'alarm' and risk > 0").drop("kind", "event_id")
